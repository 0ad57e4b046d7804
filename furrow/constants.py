"""Fixed values the results depend on. They are data, stated as they must be."""

# --- fixed values: thresholds -------------------------------------------------------------------
SCARCE_MONTHS = 1
SCARCE_RAIN = 20.8333  # monthly rain, 250 mm a year
SMALL_SCALE_QUANTILE = 0.4
MIN_USABLE_CELLS = 2
MIN_ABSTRACT_LENGTH = 200
EQUAL_AREA_CELL = 8439  # metres
EARTH_RADIUS = 6378137.0  # metres
RAIN_START = "1996-01-01"
RAIN_END = "2005-12-31"

# --- fixed values: labels -----------------------------------------------------------------------
SCARCE = "Water Scarce"
NOT_SCARCE = "Not Water Scarce"
SMALL = "Small-scale"
NOT_SMALL = "Not small-scale"
ALL_LMIC = "All LMIC Countries"
LMIC_INCOMES = ["Low income", "Lower middle income", "Upper middle income"]
REGIONS = [
    "East Asia & Pacific",
    "Europe & Central Asia",
    "Latin America & Caribbean",
    "Middle East & North Africa",
    "North America",
    "South Asia",
    "Sub-Saharan Africa",
]

# --- fixed values: country names the class list spells another way ------------------------------
COUNTRY_CODES = {
    "United States Of America": "USA",
    "Laos": "LAO",
    "Iran": "IRN",
    "Saint Lucia": "LCA",
}
SHORT_COUNTRY_NAMES = {
    "United Republic of Tanzania": "Tanzania",
    "Democratic Republic of the Congo": "Dem. Rep. Congo",
}

# --- fixed values: survey columns and categories ------------------------------------------------
SURVEY_COLUMNS = [
    "enumerator",
    "study_id",
    "title",
    "inclusion",
    "scale",
    "region",
    "country",
    "crop_livestock",
    "type_of_study",
    "interventions",
    "outcomes",
    "full_design",
    "full_design_text",
    "environmental_impacts",
    "gender",
]
SURVEY_CATEGORIES = {
    "interventions": "interventions",
    "outcomes": "outcomes",
    "environmental impacts": "environmental_impacts",
    "type of study": "type_of_study",
    "crop_livestock": "crop_livestock",
    "gender": "gender",
    "country": "country",
}
COMMA_LABELS = {
    "Observational, primary data": "Observational primary data",
    "Experimental, primary data": "Experimental primary data",
}
SURVEY_LEAD_COLUMNS = 17
SURVEY_HEAD_ROWS = 3
SURVEY_DROP_PATTERN = "text|sentiment|topic"
PREVIEW = "Survey Preview"

# --- fixed values: figure levels ----------------------------------------------------------------
SYSTEM_LEVELS = ["Crop", "Mixed", "Livestock"]
THEME_LEVELS = ["Environmental Impacts", "No Cross-Cutting Theme", "Gender"]
OUTCOME_LEVELS = ["Income/Expenditure", "Yield"]
YIELD_PATTERN = "yield|productivity"
STUDY_TYPE_NOISE = "Primary|Secondary|Data|With"

# --- fixed values: classifier grids -------------------------------------------------------------
SVM_GRID = {"C": [0.01, 0.1, 1.0], "kernel": ["rbf", "poly"], "gamma": [0.01, 0.1, 1.0]}
BAYES_GRID = {"alpha": [0.01, 0.1, 1.0]}
OUTER_FOLDS = 10
INNER_FOLDS = 5
