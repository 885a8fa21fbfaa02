"""Fixed values that must equal the reference's for equal results.

Everything here is data, stated once in natural order; the code that uses it
lives elsewhere.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — ordinal label → rank maps (nine ordinal attributes)
# ---------------------------------------------------------------------------
ORDINAL_MAPPINGS = {
    "BusinessTravel": {"Non-Travel": 1, "Travel_Rarely": 2, "Travel_Frequently": 3},
    "Education": {"Below College": 1, "College": 2, "Bachelor": 3, "Master": 4, "Doctor": 5},
    "EnvironmentSatisfaction": {"Low": 1, "Medium": 2, "High": 3, "Very High": 4},
    "JobInvolvement": {"Low": 1, "Medium": 2, "High": 3, "Very High": 4},
    "JobLevel": {"Entry Level": 1, "Junior Level": 2, "Mid Level": 3, "Senior Level": 4,
                 "Executive Level": 5},
    "JobSatisfaction": {"Low": 1, "Medium": 2, "High": 3, "Very High": 4},
    "PerformanceRating": {"Good": 1, "Excellent": 2, "Outstanding": 3},
    "RelationshipSatisfaction": {"Low": 1, "Medium": 2, "High": 3, "Very High": 4},
    "WorkLifeBalance": {"Bad": 1, "Low": 2, "Good": 3, "Better": 4, "Best": 5},
}

# FIXED VALUES — manager performance score labels; 1 and 2 are "high"
PERFORMANCE_SCORE_LABELS = {1: "Best", 2: "Good", 3: "Average", 4: "Bad"}
HIGH_PERFORMANCE = (1, 2)
LOW_PERFORMANCE = (3, 4)

# FIXED VALUES — accepted truthy / falsy spellings of the event flag
EVENT_ALLOWED = ("Yes", "No", "1", "0", "1.0", "0.0", "True", "False")
EVENT_TRUE = ("Yes", "1", "1.0", "True")

# FIXED VALUES — theme of each feature (unknown features fall to "tenure")
THEMES = ("identity", "environment", "compensation", "sentiment", "tenure")
THEME_EXACT = {
    "identity": ("age", "education", "businesstravel"),
    "environment": ("distancefromhome", "joblevel"),
    "compensation": ("monthlyincome", "percentsalaryhike", "stockoptionlevel", "dailyrate",
                     "hourlyrate", "monthlyrate"),
    "sentiment": ("environmentsatisfaction", "relationshipsatisfaction", "worklifebalance",
                  "jobinvolvement", "jobsatisfaction", "performancerating"),
    "tenure": ("yearsatcompany", "yearsincurrentrole", "yearssincelastpromotion",
               "yearswithcurrmanager", "totalworkingyears", "trainingtimeslastyear",
               "numcompaniesworked"),
}
THEME_PREFIX = {
    "identity": ("gender", "maritalstatus", "educationfield"),
    "environment": ("department", "overtime", "jobrole"),
}

# FIXED VALUES — scoring and graph constants
HORIZONS_MONTHS = (1, 3, 6, 12)
HIGH_RISK_PROBABILITY = 0.30
BOOSTED_HIGH_RISK = 50.0
RISK_BANDS = (("critical", 80.0), ("high", 50.0), ("medium", 20.0))  # else "low"
GRAPH_RISK_BANDS = (("critical", 75.0), ("high", 50.0), ("medium", 25.0))  # strictly above
TENURE_COHORTS = (("0-2", 2), ("2-5", 5), ("5-10", 10))  # else "10+"
EDGE_WEIGHTS = {"SAME_MANAGER": 1.0, "SAME_ROLE_DEPT": 0.6, "SAME_TENURE_COHORT": 0.4}
MANAGER_CHUNK = 8
ROLE_DRAWS = 5
TENURE_DRAWS = 3
EXPOSURE_DECAY = 0.1
EXPOSURE_WINDOW_DAYS = 60
PROJECTS_PER_DEPARTMENT = 4
KNN_MIN, KNN_MAX, KNN_SHARE = 3, 20, 0.1
PAY_CUT_FACTOR = 3.0

