"""Default column lists for the hourly clinical panel.

Every operator takes its columns as parameters; these are the defaults of
:func:`panelsmith.plans.preprocess.default_preprocessing`.
"""

# --- fixed values: column names of the input schema -----------------------------------------
ENTITY = "Patient_ID"
TIME = "Hour"
LABEL = "SepsisLabel"

REDUNDANT_COLUMNS = [
    "Unnamed: 0",
    "SBP",
    "DBP",
    "EtCO2",
    "BaseExcess",
    "HCO3",
    "pH",
    "PaCO2",
    "Alkalinephos",
    "Calcium",
    "Magnesium",
    "Phosphate",
    "Potassium",
    "PTT",
    "Fibrinogen",
]
SPARSE_COLUMNS = [
    "TroponinI",
    "Bilirubin_direct",
    "AST",
    "Bilirubin_total",
    "Lactate",
    "SaO2",
    "FiO2",
    "Patient_ID",
]
CATEGORICAL_COLUMNS = ["Gender", "Unit1", "Unit2"]
ONE_HOT_COLUMN = "Gender"
LOG_COLUMNS = ["MAP", "BUN", "Creatinine", "Glucose", "WBC", "Platelets"]
SCALED_COLUMNS = [
    "HR",
    "O2Sat",
    "Temp",
    "MAP",
    "Resp",
    "BUN",
    "Chloride",
    "Creatinine",
    "Glucose",
    "Hct",
    "Hgb",
    "WBC",
    "Platelets",
]
METRIC_NAMES = [
    "Accuracy",
    "Precision",
    "Recall",
    "F1 Score",
    "Mean Absolute Error",
    "Root Mean Squared Error",
    "AUC-ROC",
]
# --- end of fixed values --------------------------------------------------------------------
