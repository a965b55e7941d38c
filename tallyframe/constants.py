"""Fixed values of the data model, stated as they are."""

# Canonical column names of the responses table.
QID = "qid"
UID = "uid"
SCORE = "human_score"
EMBEDDING = "task_embedding"
REFERENCE = "yref_llm"
BASELINE = "baseline_llm_ratings_dist"

# Score range used when no score is present.
DEFAULT_SCORE_MIN = 1.0
DEFAULT_SCORE_MAX = 10.0

# Level grids of the reduction scenarios.
WORKER_COUNTS = [1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 20, 30, 40, 50, 60, 70, 80, 90, 100, 120, 140, 160, 180, 200]
TASK_COUNTS = [1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 20, 30, 40, 50, 60, 70, 80, 90, 100,
               200, 300, 400, 500, 600, 700, 800, 900, 1000]
MAX_TASKS_PER_WORKER = 20
MAX_RESPONSES_PER_TASK = 7

# Defaults of the reduction studies.
RATIO_START = 1.0
RATIO_END = 0.1
CHECK_POINTS = 50
TRIALS = 20
ABLATION_POINTS = 10

# Fixed value: a validation side needs at least this many tasks.
MIN_VALIDATION_TASKS = 5

# Fixed value: normal quantile of the 95 % half-width.
Z95 = 1.96

# Sizes of the networks.
HIDDEN_SIZE = 400
BLEND_SIZE = 10
RANDOM_VECTOR_SIZE = 768

# Persona attributes and districts.
DISTRICTS = ["District_Nord", "District_Ost", "District_S", "District_West"]
PREFERENCE_SCORES = ["how_connected", "f_district", "f_topic", "f_cost", "f_likelihood"]

# Texts of the rating status.
STATUS_VALID = "VALID"
STATUS_INVALID = "INVALID: "
NO_NUMBER = "No valid number found in response: "
MANY_NUMBERS = "Multiple candidates detected: "
NO_PERSONA = "general human"
PERSONA_SEPARATOR = " | "
