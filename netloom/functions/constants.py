"""Fixed values of the data contract (feature names, labels, limits)."""

# --- fixed values: the 57 stage-2 features, in model order -------------------
STAGE2_FEATURES = [
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Fwd Packets Length Total", "Bwd Packets Length Total",
    "Fwd Packet Length Max", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Fwd Header Length", "Bwd Header Length",
    "Fwd Packets/s", "Bwd Packets/s",
    "Packet Length Max", "Packet Length Mean", "Packet Length Std",
    "Packet Length Variance", "SYN Flag Count", "URG Flag Count",
    "Avg Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Subflow Fwd Packets", "Subflow Fwd Bytes",
    "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "Init Fwd Win Bytes", "Init Bwd Win Bytes",
    "Fwd Act Data Packets", "Fwd Seg Size Min",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]

# --- fixed values: the 20 stage-1 features, in model order --------------------
STAGE1_FEATURES = [
    "Total Fwd Packets", "Total Backward Packets", "Fwd Packets Length Total",
    "Fwd Packet Length Max", "Fwd Packet Length Mean",
    "Bwd Packet Length Max", "Bwd Packet Length Mean",
    "Fwd PSH Flags", "Fwd Header Length", "Bwd Header Length",
    "Packet Length Max", "Packet Length Mean", "Packet Length Variance",
    "SYN Flag Count", "URG Flag Count",
    "Init Fwd Win Bytes", "Init Bwd Win Bytes", "Fwd Seg Size Min",
    "Active Std", "Idle Std",
]

# --- fixed values: timing and rate columns left out of stage-1 training -------
STAGE1_EXCLUDED = [
    "Flow Duration",
    "Flow IAT Max", "Flow IAT Min", "Flow IAT Mean", "Flow IAT Std",
    "Fwd IAT Total", "Fwd IAT Max", "Fwd IAT Min", "Fwd IAT Mean", "Fwd IAT Std",
    "Bwd IAT Total", "Bwd IAT Max", "Bwd IAT Min", "Bwd IAT Mean", "Bwd IAT Std",
    "Active Mean", "Active Max", "Active Min",
    "Idle Mean", "Idle Max", "Idle Min",
    "Flow Bytes/s", "Flow Packets/s", "Fwd Packets/s", "Bwd Packets/s",
    "Init_Win_bytes_forward", "Init_Win_bytes_backward",
]

# --- fixed values: label vocabularies -----------------------------------------
BENIGN_LABELS = ["Benign", "BENIGN", "Normal", "Normal Traffic"]
NORMAL_LABELS = ["Normal Traffic", "Normal"]
SOURCE_CLASSES = ["Benign", "Botnet", "Bruteforce", "DDoS", "DoS",
                  "Infiltration", "Portscan", "Webattack"]
FOCUS_CLASSES = ["Botnet", "Bruteforce", "DDoS", "DoS", "Portscan"]
OTHER_ATTACK = "Other Attack"
OUTPUT_CLASSES = ["Benign", "Botnet", "Bruteforce", "DDoS", "DoS",
                  "Other Attack", "Portscan"]
LAB_CLASSES = ["Benign", "Botnet", "Bruteforce", "DDoS", "DoS", "Portscan"]
DISPLAY_NAMES = {
    "Benign": "Normal Traffic", "Botnet": "Botnet", "Bruteforce": "Brute Force",
    "DDoS": "DDoS", "DoS": "DoS", "Other Attack": "Other Attack",
    "Infiltration": "Infiltration", "Portscan": "Port Scan",
    "Webattack": "Web Attack",
}
LABEL_COLUMN_WORDS = ["label", "attack", "class", "category", "target", "type", "traffic"]

# --- fixed values: thresholds and limits --------------------------------------
STAGE1_THRESHOLD = 0.10
UNKNOWN_THRESHOLD = 0.60
THRESHOLD_GRID = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60,
                  0.65, 0.70, 0.75, 0.80, 0.85, 0.90]
CLIP_PERCENTILES = (0.5, 99.5)
CORRELATION_LIMIT = 0.95
CLASS_WEIGHT_POWER = 0.5
CLASS_WEIGHT_RANGE = (0.25, 10.0)
MACRO_F1_GATE = 0.70
LATENCY_GATE_MS = 250
