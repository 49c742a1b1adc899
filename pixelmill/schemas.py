"""Fixed schemas and constants shared by every stage.

The image feature order is a contract between feature preparation and
scoring: one tuple fixes it, and every vector is assembled in this order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the original application's) -------------------
# Severity grade -> class folder name; unknown grades fall back to "No_DR".
CLASS_FOLDERS = {0: "No_DR", 1: "Mild", 2: "Moderate", 3: "Severe", 4: "Proliferate_DR"}
DEFAULT_FOLDER = "No_DR"
# Served model catalogue names and the file-name prefix of saved models.
MODEL_NAMES = ("logistic_regression", "random_forest", "svm")
MODEL_PREFIX = "spark_"
# Framework labels used in comparison tables.
FRAMEWORK_SPARK = "Spark MLlib"
FRAMEWORK_TWIN = "scikit-learn"
# Decision text for a binary prediction (1 = disease detected).
DIAGNOSIS_POSITIVE = "Rétinopathie diabétique détectée"
DIAGNOSIS_NEGATIVE = "Pas de rétinopathie diabétique"
# Image side after resizing, histogram bins over [0, 256], Canny thresholds,
# epsilon inside the Hu log transform.
IMAGE_SIDE = 256
HIST_BINS = 10
HIST_RANGE = (0.0, 256.0)
CANNY_LOW, CANNY_HIGH = 100, 200
HU_EPS = 1e-10
# -----------------------------------------------------------------------------


# --- fixed values: the 42 image features, in vector order ---------------------------
FEATURE_NAMES: tuple[str, ...] = (
    "R_mean", "R_std", "R_skew", "G_mean", "G_std", "G_skew", "B_mean", "B_std", "B_skew",
    "H_mean", "H_std", "H_skew", "S_mean", "S_std", "S_skew", "V_mean", "V_std", "V_skew",
    "intensity_hist_0", "intensity_hist_1", "intensity_hist_2", "intensity_hist_3", "intensity_hist_4",
    "intensity_hist_5", "intensity_hist_6", "intensity_hist_7", "intensity_hist_8", "intensity_hist_9",
    "contrast", "brightness", "min_intensity", "max_intensity", "entropy",
    "hu_moment_0", "hu_moment_1", "hu_moment_2", "hu_moment_3", "hu_moment_4", "hu_moment_5", "hu_moment_6",
    "edge_density", "edge_mean",
)
# --------------------------------------------------------------------------------------
assert len(FEATURE_NAMES) == 42

LABEL_SCHEMA = T.StructType([
    T.StructField("id_code", T.StringType()),
    T.StructField("diagnosis", T.IntegerType()),
])

METRIC_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("auc_roc", T.DoubleType()),
    T.StructField("training_time", T.DoubleType()),
])

COMPARISON_SCHEMA = T.StructType([
    T.StructField("Model", T.StringType()),
    T.StructField("Framework", T.StringType()),
    T.StructField("Accuracy", T.DoubleType()),
    T.StructField("F1-Score", T.DoubleType()),
    T.StructField("AUC-ROC", T.DoubleType()),
    T.StructField("Training Time", T.DoubleType()),
])

# Schema of rows produced by Spark's built-in ``image`` source.
IMAGE_STRUCT = T.StructType([
    T.StructField("origin", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("nChannels", T.IntegerType()),
    T.StructField("mode", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
])
