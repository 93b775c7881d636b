"""Phrases, patterns, word lists, weights and thresholds that results depend on."""

from __future__ import annotations

# Time gaps in seconds.
TURN_GAP = 0.8
PAUSE_GAP = 0.45
MIN_PROSODY_SECONDS = 1.2
MIN_PROSODY_WORDS = 4

# Weights of the fused mood score.
TEXT_WEIGHT = 0.7
PROSODY_WEIGHT = 0.3
RATE_EFFECT = 0.6
PAUSE_EFFECT = 0.4

# Change point.
MIN_SERIES = 5
MIN_SEGMENT = 2
PENALTY_SCALE = 2.0
MIN_VARIANCE = 1e-3
MIN_DELTA = 0.12
SHIFT_NEGATIVE_FLOOR = -0.15

# Attention score.
WEIGHT_RESOLUTION = 0.30
WEIGHT_MOOD_SEVERITY = 0.20
WEIGHT_MOOD_SHIFT = 0.15
WEIGHT_ESCALATION = 0.20
WEIGHT_REPEAT = 0.10
WEIGHT_HANDLE_TIME = 0.05
WEIGHT_CONTRADICTION = 0.20
MOOD_CLAIM_FLOOR = -0.20
HANDLE_TIME_START = 1.2
HANDLE_TIME_OUTLIER = 2.0

# Verification.
MIN_QUOTE_WORDS = 5
MAX_QUOTE_WORDS = 30
SPAN_THRESHOLD = 85.0
MIN_SPAN_RATIO = 0.6
VECTOR_SUPPORT = 0.42
LEXICAL_SUPPORT = 0.45
COSINE_BASE = 0.3
REASON_SHORT = "quote shorter than 5 words — too generic to support a claim"
REASON_ABSENT = "quote does not occur in the cited turn"
REASON_FRAGMENT = "only a fragment of the quote matched — high score on a short span"
REASON_UNSUPPORTED = "quote occurs in the transcript but does not support the claim"
SPAN_ONLY_CLAIMS = ("mood_shift", "attention_factor")

# Repeat contact, clustering, judgments, views.
REPEAT_WINDOW_DAYS = 30
MIN_REPEAT_CALLS = 3
MIN_CLUSTER_SIZE = 5
MIN_CLUSTER_FRACTION = 0.015
MERGE_SIMILARITY = 0.90
TERM_SHARE = 0.33
MAX_SUMMARY_WORDS = 40
RESOLUTIONS = ("resolved", "unresolved", "partial")
MIN_ISSUE_CALLS = 8
WEAK_ISSUE_DELTA = -0.10
ISSUE_ALERT_GAP = 0.05

# Phrases by which a customer escalates, in order.
ESCALATION_PHRASES = (
    "speak to a manager",
    "speak to your manager",
    "talk to a manager",
    "supervisor",
    "cancel my account",
    "close my account",
    "unacceptable",
    "ridiculous",
    "lawsuit",
    "lawyer",
    "file a complaint",
    "third time",
    "fourth time",
    "again and again",
    "still waiting",
    "no one has",
    "nobody has",
)

# Words of plain refusal.
REFUSAL_WORDS = ("no", "nope", "nah", "not", "none", "never", "n't", "nothing")

# Turns that carry no mood (closing pleasantries, dictated numbers).
PLEASANTRY = (
    r"(?i)^(no,? )?(thank(s| you)?|thanks so much|thank you (so |very )?much|you too|you as well"
    r"|bye|bye-bye|goodbye|have a (good|great|nice) (day|one)|no problem"
    r"|okay|ok|alright|all right|sure|yeah|yes|no|nope|nah|um+|uh+|mm+|hmm+"
    r"|that'?s (it|all|great|perfect)|nothing else|that'?ll be (it|all))"
    r"[\s.,!]*$"
)
DICTATION = r"^[^a-zA-Z]*\d[\d\s.,$#-]*$"

# An agent claiming a fix, a customer denying it.
AGENT_CLAIM = (
    r"(?i)(should\s+(be|have)\s+(all\s+set|fixed|resolved|sorted|taken\s+care\s+of)"
    r"|(is|has\s+been|should\s+be)\s+(now\s+)?(resolved|fixed)"
    r"|you'?re\s+all\s+set"
    r"|that\s+should\s+(do\s+it|take\s+care\s+of\s+it))"
)
CUSTOMER_PUSHBACK = (
    r"(?i)(still\s+(not\s+working|failing|broken|the\s+same|doesn'?t\s+work|not\s+fixed"
    r"|have\s+(the|this)\s+(same\s+)?(problem|issue))"
    r"|(didn'?t|did\s+not|does\s?n'?t)\s+(fix|solve|work)"
    r"|same\s+(problem|issue)\s+(again|as\s+before)"
    r"|that'?s\s+not\s+(fixed|right|working))"
)

# An agent's scripted opening.
GREETING = (
    r"(?i)(hello|hi)[,.]?\s*(this is|hello,? this is).{0,25}(valley|national)\s*"
    r"(national\s*)?bank\.?\s*my name is \w+"
)

# Claim texts.
CLAIM_SHIFT_WORSE = "the customer's mood turned worse at this point in the call"
CLAIM_SHIFT_BETTER = "the customer's mood turned better at this point in the call"
CLAIM_AGENT_RESOLVED = (
    "the agent confirmed the customer's issue was resolved and everything should now work"
)
CLAIM_CUSTOMER_DENIES = (
    "the customer says the problem is still happening and was not actually fixed"
)
FACTOR_MOOD = "lowest customer mood"
FACTOR_SHIFT = "mood turned negative during the call"
FACTOR_LONG = "unusually long call"
FACTOR_CONTRADICTION = "customer's later words contradict the agent's \"resolved\" claim"

# Words too general to name an issue.
#: Texts whose term vectors have a smaller cosine are not linked when issues are formed.
TEXT_LINK = 0.2
ISSUE_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "to", "of", "in", "on", "for", "with",
    "customer", "agent", "call", "caller", "bank", "account", "wants", "wanted",
    "asked", "asks", "issue", "about", "their", "they", "them", "his", "her",
    "was", "were", "is", "are", "be", "been", "has", "had", "have", "it", "that",
    "this", "not", "no", "you", "your", "we", "i", "he", "she", "at", "by",
    "intent", "outcome", "entered", "request", "requested", "confirmed",
    "customer's", "status", "completed", "provided", "gathered", "gave",
    "ended", "promised", "from", "as", "s", "t", "resolved", "unresolved",
)

# Sentiment rule constants (Hutto & Gilbert 2014).
NEGATION_FACTOR = -0.74
BOOST = 0.293
BOOST_DECAY = (1.0, 0.95, 0.9)
CAPS_BOOST = 0.733
BUT_BEFORE = 0.5
BUT_AFTER = 1.5
EXCLAMATION_STEP = 0.292
MAX_EXCLAMATIONS = 4
QUESTION_STEP = 0.18
QUESTION_MAX = 0.96
VALENCE_ALPHA = 15.0
NEGATORS = (
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere", "without", "cannot",
    "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "can't", "couldn't", "won't",
    "wouldn't", "shouldn't", "hasn't", "haven't", "hadn't",
)
BOOST_UP = (
    "absolutely", "completely", "deeply", "entirely", "especially", "extremely", "highly", "incredibly",
    "more", "most", "particularly", "really", "so", "totally", "truly", "utterly", "very",
)
BOOST_DOWN = (
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly",
    "scarcely", "slightly", "somewhat", "sorta",
)

# What each factor of the attention score says about itself, in the order of the factors.
DETAIL_RESOLUTION = "resolution status: "
DETAIL_MOOD = "worst mood score %.2f"
DETAIL_SHIFT = "mood fell by %.2f"
DETAIL_ESCALATION = "%d escalation phrase(s)"
DETAIL_REPEAT = "%d earlier call(s) about this issue"
DETAIL_HANDLE_TIME = "%.1fx the median handle time"
DETAIL_CONTRADICTION = "resolution reality check"

# A small default lexicon (word, valence), with valences as in the published VADER lexicon (Hutto and Gilbert
# 2014); pass a larger one where it matters.
DEFAULT_LEXICON = (
    ("angry", -2.3), ("annoyed", -1.6), ("appreciate", 1.7), ("awful", -2.0), ("bad", -2.5), ("broken", -2.1),
    ("charged", -0.8), ("complaint", -1.7), ("confused", -1.3), ("disappointed", -1.8), ("excellent", 2.7),
    ("failed", -2.3), ("fine", 0.8), ("frustrated", -2.4), ("frustrating", -2.1), ("furious", -2.7), ("glad", 2.0),
    ("good", 1.9), ("great", 3.1), ("happy", 2.7), ("hate", -2.7), ("help", 1.7), ("helpful", 1.8), ("horrible", -2.5),
    ("lawsuit", -0.9), ("lost", -1.3), ("love", 3.2), ("lovely", 2.8), ("nice", 1.8), ("no", -1.2), ("perfect", 2.7),
    ("please", 1.3), ("pleased", 1.9), ("problem", -1.7), ("ridiculous", -1.5), ("sad", -2.1), ("satisfied", 1.8),
    ("sorry", -0.3), ("terrible", -2.1), ("thank", 1.5), ("thanks", 1.9), ("unacceptable", -2.0), ("unhappy", -1.8),
    ("upset", -1.6), ("useless", -1.8), ("waiting", -0.6), ("wonderful", 2.7), ("worse", -2.1), ("worst", -3.1),
    ("wrong", -2.1),
)
