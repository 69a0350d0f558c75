"""Results depend on these exact numbers and names."""

# dataset geometry
WINDOW_PX = 224
PATCH_PX = 96
BOX_MARGIN = 2.2
CROPS_PER_BOX = 2
NEGATIVES_SMOKE_FRAME = 3
NEGATIVES_CLEAN_FRAME = 4
ATTEMPTS_PER_NEGATIVE = 25
NEGATIVE_SIDE = (0.85, 1.6)
JITTER_SHARE = 0.6
FRAME_SIZE = (1280, 720)
OVERLAP = (1, 4)

# splits
HELD_OUT_PARTNER = "sdis-77"
PART_TRAIN, PART_VAL, PART_HELD_OUT = "train", "val", "cruzado"
VAL_PERCENT = 20
SEED = 42

# provenance of a patch
POSITIVE, HARD, CLEAN = "positive", "duro", "limpio"

# detection rule and goals
ALERT_X1000 = 970
MIN_TILES = 1
GOALS = {"recall": 0.90, "precision": 0.80, "f1": 0.75, "fpr": 0.10}
CAPTURES_PER_DAY = 48
CADENCE_MIN = 15
CLEAN_TILES = 31
CURVE_FPRS = (0.10, 0.01, 0.0034, 0.001, 0.00032)
DETECTION_CAPTURES = (1, 2, 4, 8, 12)

# haze
HAZE_PROB = 0.35
HAZE_MAX_ALPHA = 0.45
HAZE_VEIL = (180.0, 255.0)

# node policy
DAY_HOURS = (6, 18)
HIGH_RISK_HOURS = (9, 17)
INTERVAL_NORMAL_S = 15 * 60
INTERVAL_SAVING_S = 60 * 60
INTERVAL_CRITICAL_S = 180 * 60
SOC_SAVING = 35
SOC_CRITICAL = 15
MAX_ALERTS_PER_HOUR = 2
HEARTBEAT_HOUR = 7
VALID_EPOCH_S = 1577836800
WEAK_RSSI_DBM = -75

# battery voltage (mV) to charge (%)
BATTERY_CURVE = (
    (3400, 100), (3300, 90), (3250, 70), (3200, 40),
    (3150, 20), (3000, 10), (2800, 5), (2500, 0),
)

# uplink frames
PORT_ALERT, PORT_HEARTBEAT = 10, 11
ALERT_BYTES, HEARTBEAT_BYTES = 6, 14
MSG_HEARTBEAT, MSG_SMOKE, MSG_LOW_BATTERY, MSG_TEST = 0, 1, 2, 3
EVENT_NAMES = {0: "heartbeat", 1: "humo", 2: "bateria_baja", 3: "test"}
FLAG_BITS = {
    "alarma_activa": 0x01,
    "tamper": 0x02,
    "error_camara": 0x04,
    "error_modelo": 0x08,
    "modo_ahorro": 0x10,
}

# threshold grids
PATCH_GRID = tuple(round((10 + 5 * i) / 1000, 4) for i in range(197))
FRAME_GRID = tuple(round((5 + i) / 100, 3) for i in range(95))
