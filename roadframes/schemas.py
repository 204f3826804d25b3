"""Fixed schemas and constants of the data model."""

from pyspark.sql import types as T

# Channel statistics used to normalise stored tensors.
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)

# Scorer defaults, and the learner's own threshold defaults.
SCORER_DEFAULTS = {
    "density_weight": 1.0,
    "congestion_weight": 1.0,
    "edge_threshold": 50,
    "thresholds": [0.1, 0.3, 0.5, 0.7],
}
LEARNER_THRESHOLDS = [0.2, 0.4, 0.6, 0.8]

# Names of the five traffic levels, 0 to 4.
LEVEL_NAMES = [
    "No traffic",
    "Light traffic",
    "Moderate traffic",
    "Heavy traffic",
    "Severe congestion",
]

# The two cameras and their pages.
CAMERAS = [
    ("US_50_AT_SANDY_POINT", "https://mdta.maryland.gov/index.php/traffic-cameras-by-facility#camera-28"),
    ("US_50_AT_EX23_MD2", "https://mdta.maryland.gov/index.php/traffic-cameras-by-facility#camera-48"),
]

FRAMES = T.StructType([
    T.StructField("frame_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("layout", T.StringType()),
    T.StructField("pixels", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])

IMAGE = T.StructType([
    T.StructField("origin", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("nChannels", T.IntegerType()),
    T.StructField("mode", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
])

PARAMS = T.StructType([
    T.StructField("density_weight", T.DoubleType()),
    T.StructField("congestion_weight", T.DoubleType()),
    T.StructField("edge_threshold", T.IntegerType()),
    T.StructField("thresholds", T.ArrayType(T.DoubleType())),
])

FEEDBACK_ENTRY = T.StructType([
    T.StructField("image_index", T.LongType()),
    T.StructField("model_prediction", T.DoubleType()),
    T.StructField("user_correction", T.DoubleType()),
    T.StructField("was_correct", T.BooleanType()),
    T.StructField("density", T.DoubleType()),
    T.StructField("congestion", T.DoubleType()),
])

FEEDBACK_SESSION = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("feedback", T.ArrayType(FEEDBACK_ENTRY)),
    T.StructField("session_duration", T.DoubleType()),
    T.StructField("metadata", T.StructType([
        T.StructField("timestamp", T.StringType()),
        T.StructField("total_images", T.LongType()),
        T.StructField("correct_predictions", T.LongType()),
        T.StructField("session_duration", T.DoubleType()),
        T.StructField("session_images", T.LongType()),
        T.StructField("session_correct", T.LongType()),
    ])),
])
