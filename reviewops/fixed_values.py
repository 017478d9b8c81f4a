"""Domain constants that results depend on.

Everything in this module is data: dictionaries, thresholds and texts that must
keep exactly these values for results to be comparable. Order matters wherever
a list is used to break ties.
"""

from __future__ import annotations

# --- Fixed values: complaint topics and the words that reveal them ----------
TOPIC_KEYWORDS: dict[str, list[str]] = {
    "cleanliness": [
        "dirty", "filthy", "stain", "stained", "smell", "smelly", "unclean", "hair", "dust", "dusty",
        "mold", "mould", "garbage", "grime", "grimy", "cockroach", "insects", "bugs", "bathroom dirty",
        "toilet dirty", "not cleaned", "poorly cleaned", "disgusting",
    ],
    "staff": [
        "rude", "unhelpful", "unfriendly", "staff", "receptionist", "service", "attitude", "ignored",
        "waited", "slow", "arrogant", "dismissive", "impolite", "indifferent", "unprofessional",
        "front desk", "check in", "check out", "reception",
    ],
    "maintenance": [
        "broken", "not working", "ac", "air conditioning", "heating", "tv", "television", "elevator",
        "lift", "plumbing", "leak", "leaking", "shower", "toilet flush", "light bulb", "bulb", "socket",
        "plug", "outlet", "repair", "maintenance", "didn't work", "stopped working",
    ],
    "noise": [
        "noisy", "noise", "loud", "thin walls", "heard everything", "next door", "street noise",
        "traffic noise", "bar noise", "music", "party", "neighbours", "neighbors", "kept awake",
        "couldn't sleep", "could not sleep", "disruptive",
    ],
    "wifi": [
        "wifi", "wi-fi", "internet", "connection", "slow internet", "no wifi", "no internet",
        "weak signal", "disconnected", "offline", "bandwidth", "broadband",
    ],
    "breakfast": [
        "breakfast", "brunch", "buffet", "food", "meal", "eggs", "toast", "cereal", "juice", "coffee",
        "tea", "tasteless", "cold food", "poor food", "limited choice", "expensive breakfast",
        "not included", "dining",
    ],
    "value": [
        "overpriced", "expensive", "not worth", "poor value", "too much", "price", "cost", "cheap",
        "ripoff", "rip off", "money", "rate", "fee", "charge", "extortionate",
    ],
    "location": [
        "location", "far from", "distance", "remote", "inconvenient", "transport", "bus stop", "tube",
        "metro", "subway", "underground", "taxi", "walk", "centre", "center", "attractions",
    ],
}
TOPICS: list[str] = list(TOPIC_KEYWORDS)

# --- Fixed values: root causes, their words, descriptions and priors --------
CAUSE_KEYWORDS: dict[str, list[str]] = {
    "UNDERSTAFFING": [
        "understaffed", "not enough staff", "short staffed", "short-staffed", "overworked",
        "rushed staff", "too busy", "couldn't find anyone", "no one available", "waited ages",
        "nobody came", "staff missing", "overwhelmed", "too few staff",
    ],
    "TRAINING_ISSUES": [
        "didn't know", "didn't seem to know", "untrained", "new staff", "inconsistent", "hit or miss",
        "unprofessional", "clueless", "no idea", "poorly trained", "lack of training", "seems new",
        "inexperienced",
    ],
    "EQUIPMENT_ISSUES": [
        "broken", "not working", "stopped working", "out of order", "needs replacement",
        "old equipment", "outdated", "faulty", "keeps breaking", "malfunctioning", "worn out",
    ],
    "TIME_PRESSURE": [
        "rushed", "hurried", "not enough time", "quick clean", "fast checkout",
        "not given enough time", "in a rush", "cutting corners", "too fast",
    ],
    "SUPPLY_CHAIN_ISSUES": [
        "out of stock", "no supplies", "ran out", "missing items", "no toiletries", "no towels",
        "no amenities", "couldn't get", "supply problem", "not available",
    ],
    "PROCESS_INEFFICIENCY": [
        "disorganised", "disorganized", "chaotic", "no system", "wrong room", "booking error",
        "mistake", "confused", "mixed up", "unclear process", "poor process", "didn't follow up",
        "lost complaint",
    ],
    "COMMUNICATION_BREAKDOWN": [
        "didn't tell", "wasn't informed", "not notified", "no communication", "left in the dark",
        "no response", "ignored complaint", "nobody told us", "miscommunication", "mixed messages",
        "didn't get back", "no follow up",
    ],
}
CAUSES: list[str] = list(CAUSE_KEYWORDS)

CAUSE_DESCRIPTIONS: dict[str, str] = {
    "UNDERSTAFFING": "Insufficient staff to handle guest volume",
    "TRAINING_ISSUES": "Staff lack skills or knowledge to perform tasks correctly",
    "EQUIPMENT_ISSUES": "Broken or outdated equipment impairs service delivery",
    "TIME_PRESSURE": "Staff are given insufficient time to complete tasks properly",
    "SUPPLY_CHAIN_ISSUES": "Lack of necessary supplies prevents service fulfilment",
    "PROCESS_INEFFICIENCY": "Poorly designed processes lead to errors or inconsistency",
    "COMMUNICATION_BREAKDOWN": "Poor internal communication causes guests to receive conflicting or no information",
}

CAUSE_PRIORS: dict[str, list[str]] = {
    "cleanliness": ["UNDERSTAFFING", "TIME_PRESSURE", "PROCESS_INEFFICIENCY"],
    "staff": ["TRAINING_ISSUES", "COMMUNICATION_BREAKDOWN", "UNDERSTAFFING"],
    "maintenance": ["EQUIPMENT_ISSUES", "SUPPLY_CHAIN_ISSUES", "PROCESS_INEFFICIENCY"],
    "noise": ["PROCESS_INEFFICIENCY", "COMMUNICATION_BREAKDOWN", "TIME_PRESSURE"],
    "wifi": ["EQUIPMENT_ISSUES", "SUPPLY_CHAIN_ISSUES", "PROCESS_INEFFICIENCY"],
    "breakfast": ["SUPPLY_CHAIN_ISSUES", "TIME_PRESSURE", "PROCESS_INEFFICIENCY"],
    "value": ["PROCESS_INEFFICIENCY", "UNDERSTAFFING", "COMMUNICATION_BREAKDOWN"],
    "location": ["COMMUNICATION_BREAKDOWN", "PROCESS_INEFFICIENCY", "UNDERSTAFFING"],
}
DEFAULT_CAUSE_PRIORS = ["PROCESS_INEFFICIENCY", "COMMUNICATION_BREAKDOWN"]
SPARSE_EVIDENCE = (
    "Sparse evidence mode: only %d complaint review(s) available for this topic.",
    "Plan is generated using conservative fallback root-cause priors.",
)

# --- Fixed values: review placeholders and word lists -----------------------
PART_PLACEHOLDERS = [
    "no negative", "nothing", "none", "n/a", "no positive", "nothing to note", "no comment", "no complaints",
]
EMPTY_PLACEHOLDERS = PART_PLACEHOLDERS + ["nothing negative", "nothing positive"]
NEGATIONS = [
    "not", "no", "never", "neither", "nor", "don't", "doesn't", "didn't", "won't", "wouldn't", "can't",
    "cannot", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "shouldn't", "couldn't",
]
#: One class holds all single characters that may follow: each of the usual groups (letters, digits, signs) would match one of them at a time anyway.
URL_PATTERN = r"https?://(?:[a-zA-Z0-9$\-_@.&+!*\\(),]|%[0-9a-fA-F]{2})+"

#: English stop words, as public lists have them, with the stumps that contractions leave.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "couldn", "didn",
    "doesn", "hadn", "hasn", "haven", "isn", "ma", "mightn", "mustn", "needn", "shan", "shouldn", "wasn", "weren",
    "won", "wouldn",
]

# --- Fixed values: valence (-4..4), subjectivity (0..1), words --------------
# Valences and subjectivities are held in hundredths so that sums stay exact.
LEXICON: list[tuple[int, int, list[str]]] = [
    (320, 95, [
        "excellent", "amazing", "fantastic", "wonderful", "outstanding", "superb", "perfect", "brilliant",
        "exceptional",
    ]),
    (270, 80, [
        "great", "lovely", "love", "loved", "beautiful", "delicious", "awesome", "delightful", "best",
    ]),
    (190, 60, [
        "good", "nice", "friendly", "helpful", "comfortable", "enjoyed", "enjoy", "pleasant", "happy",
        "polite", "recommend", "cosy", "cozy",
    ]),
    (120, 40, [
        "clean", "quiet", "spacious", "fine", "convenient", "modern", "fresh", "central", "attentive", "fast",
        "okay", "ok", "easy",
    ]),
    (-120, 40, [
        "cold", "slow", "small", "old", "late", "far", "busy", "expensive", "noise", "queue", "delay",
        "tired", "outdated", "dated",
    ]),
    (-190, 60, [
        "dirty", "noisy", "loud", "overpriced", "broken", "smelly", "poor", "unhelpful", "unfriendly", "bad",
        "uncomfortable", "faulty", "understaffed", "mistake", "error", "wrong", "rushed", "stained", "dusty",
        "problem", "problems", "complaint",
    ]),
    (-270, 80, [
        "rude", "filthy", "clueless", "chaotic", "unacceptable", "disappointing", "disappointed", "worst",
        "unprofessional", "arrogant", "ignored", "ripoff", "mouldy", "hate", "hated",
    ]),
    (-320, 95, [
        "terrible", "horrible", "awful", "disgusting", "dreadful", "appalling", "atrocious", "nightmare",
    ]),
]
NEGATION_FACTOR = -74      # hundredths: a negated word keeps 74 % of its strength, reversed
NEGATION_REACH = 3         # words looked back for a negation
SCORE_ALPHA = 15           # normaliser of the published rule-based method

# --- Fixed values: scoring, cost and revenue constants ----------------------
CAUSE_CONFIDENCE_MIN = 10.0
PLAN_CONFIDENCE_MIN = 60.0
PRIORITY_BANDS = [(60, "CRITICAL"), (40, "HIGH"), (20, "MEDIUM")]
TREND_POINTS = {"INCREASING": 10, "STABLE": 5, "DECREASING": 0}
TREND_ICONS = {"INCREASING": "↑", "STABLE": "→", "DECREASING": "↓"}
TREND_WORDS = {"INCREASING": "Worsening", "STABLE": "Stable", "DECREASING": "Improving"}
COST_CONSTANTS = {"STAFF_COST_PER_ROOM": 30, "TRAINING_COST_BASE": 1200, "EQUIPMENT_COST_PER_ROOM": 100}
RATING_TO_OCCUPANCY = 0.05
COMPLAINT_REDUCTION = 0.70
OCCUPANCY_CAP = 0.95
DEFAULT_RATING = 3.5
DEFAULT_COMPLAINT_RATE = 0.30
DAYS_PER_MONTH = 30

# --- Fixed values: accepted date formats, in order --------------------------
DATE_FORMATS = ["M/d/yyyy", "yyyy-M-d", "d/M/yyyy", "MMMM d, yyyy", "d MMMM yyyy"]

# --- Fixed values: upload column aliases ------------------------------------
COLUMN_ALIASES: dict[str, list[str]] = {
    "Hotel_Name": ["hotel_name", "hotel", "property", "property_name", "hotel name"],
    "Review_Date": ["review_date", "date", "reviewed_at", "review date"],
    "Reviewer_Score": ["reviewer_score", "rating", "score", "review_score", "stars"],
    "Negative_Review": ["negative_review", "negative", "cons", "complaint"],
    "Positive_Review": ["positive_review", "positive", "pros", "praise"],
    "review_text": ["review_text", "review", "comment", "feedback", "review body"],
    "Hotel_Address": ["hotel_address", "address", "location"],
}
FALLBACK_HOTEL = "Uploaded Hotel"

# --- Fixed values: action templates -----------------------------------------
# (cause, timeframe, action, cost formula, timeline, expected impact)
TIMEFRAMES = ["immediate", "short_term", "long_term"]
ACTION_TEMPLATES: list[tuple[str, str, str, str, str, str]] = [
    ("UNDERSTAFFING", "immediate",
     "Hire additional housekeeping staff",
     "rooms * 36", "This week - post job ads immediately",
     "Reduces workload by 30-40%, improves cleaning quality"),
    ("UNDERSTAFFING", "immediate",
     "Redistribute current workload and optimise shift schedules",
     "0", "1-2 days",
     "Temporary 10-15% efficiency gain while hiring proceeds"),
    ("UNDERSTAFFING", "short_term",
     "Implement staff scheduling software (e.g., Deputy or Humanity)",
     "500 + (rooms * 0.5)", "2-4 weeks",
     "Better peak-time coverage, 20% efficiency boost"),
    ("UNDERSTAFFING", "short_term",
     "Partner with a hospitality temp agency for flexible cover",
     "rooms * 15", "2-3 weeks",
     "Eliminates gaps during high-demand periods"),
    ("UNDERSTAFFING", "long_term",
     "Develop staff retention and incentive programme",
     "rooms * 10", "3 months",
     "Reduces turnover by 30%, maintains consistent quality"),
    ("UNDERSTAFFING", "long_term",
     "Introduce cross-training so all front-of-house staff cover housekeeping peaks",
     "TRAINING_COST_BASE", "3-4 months",
     "Built-in flexibility; 15% reduction in dependency on external hire"),
    ("TRAINING_ISSUES", "immediate",
     "Run a one-day refresher session on brand standards and guest expectations",
     "200 + (rooms * 0.5)", "Within 1 week",
     "Immediate uplift in consistency; addresses known skill gaps quickly"),
    ("TRAINING_ISSUES", "immediate",
     "Create quick-reference SOP cards for common guest interactions",
     "150", "3-5 days",
     "Reduces reliance on memory; faster onboarding for new hires"),
    ("TRAINING_ISSUES", "short_term",
     "Enrol all guest-facing staff in accredited hospitality training course",
     "TRAINING_COST_BASE + (rooms * 2)", "4-6 weeks",
     "Structured skill development; targets 78% improvement in service scores"),
    ("TRAINING_ISSUES", "short_term",
     "Implement monthly mystery-guest audits with coaching feedback",
     "300 + (rooms * 1)", "1 month to set up; ongoing",
     "Continuous improvement culture; 20% improvement per quarter"),
    ("TRAINING_ISSUES", "long_term",
     "Establish an internal training academy with e-learning modules",
     "2000 + (rooms * 5)", "3-6 months",
     "Scalable, consistent training; reduces onboarding time by 40%"),
    ("TRAINING_ISSUES", "long_term",
     "Create clear career-progression pathways tied to training milestones",
     "rooms * 8", "4-5 months",
     "Improves staff motivation and retention by 25%"),
    ("EQUIPMENT_ISSUES", "immediate",
     "Conduct full equipment audit and tag all faulty items for priority repair",
     "0", "2-3 days",
     "Prevents guests encountering known broken equipment"),
    ("EQUIPMENT_ISSUES", "immediate",
     "Arrange emergency repair contracts for HVAC and plumbing",
     "500 + (rooms * 3)", "1 week",
     "Resolves high-impact failures quickly; reduces 1-star reviews"),
    ("EQUIPMENT_ISSUES", "short_term",
     "Replace end-of-life equipment in highest-complaint room categories",
     "rooms * EQUIPMENT_COST_PER_ROOM", "3-6 weeks",
     "Direct reduction in maintenance complaints; improves comfort scores"),
    ("EQUIPMENT_ISSUES", "short_term",
     "Introduce a preventive maintenance schedule using a CMMS tool",
     "800 + (rooms * 2)", "4 weeks",
     "Reduces breakdown frequency by 50% within 6 months"),
    ("EQUIPMENT_ISSUES", "long_term",
     "Phased capital refresh programme for all in-room technology",
     "rooms * 50", "6-12 months",
     "Modernises guest experience; targets top-10% TripAdvisor ranking"),
    ("EQUIPMENT_ISSUES", "long_term",
     "Negotiate long-term service contracts with equipment vendors",
     "rooms * 15", "3-4 months",
     "Reduces repair costs by 30%; guaranteed response times"),
    ("TIME_PRESSURE", "immediate",
     "Extend housekeeping shift overlap to allow proper room-turn time",
     "rooms * 5", "2-3 days",
     "Reduces rushed cleans; 20% improvement in cleanliness scores"),
    ("TIME_PRESSURE", "immediate",
     "Implement staggered check-out times to spread workload",
     "0", "Immediately",
     "Reduces peak-hour bottlenecks by 25%"),
    ("TIME_PRESSURE", "short_term",
     "Introduce express room-cleaning checklists with time targets per task",
     "100 + (rooms * 0.5)", "2-3 weeks",
     "Maintains quality under time constraints; 15% faster compliant cleans"),
    ("TIME_PRESSURE", "short_term",
     "Use mobile housekeeping management app for real-time room status",
     "600 + (rooms * 1)", "3-4 weeks",
     "Eliminates wasted trips; 10-15% time saving per shift"),
    ("TIME_PRESSURE", "long_term",
     "Reconfigure check-in/check-out policy to maximise cleaning windows",
     "0", "2-3 months (requires PMS config)",
     "Structural fix; sustainable improvement without extra headcount"),
    ("TIME_PRESSURE", "long_term",
     "Invest in faster-drying linen and commercial-grade cleaning equipment",
     "rooms * 30", "3-4 months",
     "Cuts room-turn time by 20%; enables same-day reletting"),
    ("SUPPLY_CHAIN_ISSUES", "immediate",
     "Audit current stock levels and identify critical shortages",
     "0", "1 day",
     "Prevents guests experiencing missing amenities"),
    ("SUPPLY_CHAIN_ISSUES", "immediate",
     "Place emergency orders from secondary suppliers to cover gaps",
     "rooms * 20", "3-5 days",
     "Restores full amenity provision within the week"),
    ("SUPPLY_CHAIN_ISSUES", "short_term",
     "Diversify supplier base to at least two approved vendors per category",
     "200", "3-4 weeks",
     "Eliminates single-supplier dependency; 80% reduction in stock-out risk"),
    ("SUPPLY_CHAIN_ISSUES", "short_term",
     "Implement par-level stock system with automated reorder alerts",
     "400 + (rooms * 1)", "4-6 weeks",
     "Prevents shortages; reduces emergency procurement costs by 40%"),
    ("SUPPLY_CHAIN_ISSUES", "long_term",
     "Negotiate annual supply contracts with volume discounts",
     "rooms * 5", "3 months",
     "15-20% cost reduction; guaranteed availability"),
    ("SUPPLY_CHAIN_ISSUES", "long_term",
     "Integrate purchasing with PMS to auto-calculate stock requirements by occupancy",
     "1500 + (rooms * 3)", "4-6 months",
     "Eliminates manual ordering errors; 25% reduction in waste"),
    ("PROCESS_INEFFICIENCY", "immediate",
     "Map the current end-to-end guest complaint process and identify bottlenecks",
     "0", "2-3 days",
     "Provides clear baseline for process improvement"),
    ("PROCESS_INEFFICIENCY", "immediate",
     "Empower front-desk staff to resolve Tier-1 complaints without manager approval",
     "50", "3-5 days (policy update)",
     "Reduces complaint resolution time from hours to minutes"),
    ("PROCESS_INEFFICIENCY", "short_term",
     "Introduce a digital guest-issue log with SLA targets per complaint type",
     "500 + (rooms * 2)", "3-4 weeks",
     "Accountability and tracking; 30% faster average resolution"),
    ("PROCESS_INEFFICIENCY", "short_term",
     "Redesign room-inspection checklist using lean 5S principles",
     "300", "2-3 weeks",
     "Cuts inspection time by 15% without quality loss"),
    ("PROCESS_INEFFICIENCY", "long_term",
     "Conduct full ISO-9001-aligned process review for all guest-facing operations",
     "2500 + (rooms * 5)", "4-6 months",
     "Systematic quality uplift; targets 25% reduction in all complaint categories"),
    ("PROCESS_INEFFICIENCY", "long_term",
     "Implement a property management system upgrade with automated workflow triggers",
     "3000 + (rooms * 10)", "6 months",
     "End-to-end automation; 40% reduction in administrative overhead"),
    ("COMMUNICATION_BREAKDOWN", "immediate",
     "Hold daily 10-minute team stand-ups to share key guest feedback and priorities",
     "0", "Immediately",
     "Keeps all staff aligned; prevents repeat complaints from same guests"),
    ("COMMUNICATION_BREAKDOWN", "immediate",
     "Create a shared digital notice board for real-time alerts (e.g. VIP arrivals, complaints)",
     "100", "1-2 days",
     "Reduces information silos; 20% faster cross-department response"),
    ("COMMUNICATION_BREAKDOWN", "short_term",
     "Deploy a messaging platform (e.g. Slack, Microsoft Teams) for all departments",
     "200 + (rooms * 0.5)", "2-3 weeks",
     "Instant communication; eliminates phone tag and missed handovers"),
    ("COMMUNICATION_BREAKDOWN", "short_term",
     "Introduce weekly management review of all negative reviews with root-cause discussion",
     "0", "Start next week",
     "Closes feedback loop; prevents issues recurring week-on-week"),
    ("COMMUNICATION_BREAKDOWN", "long_term",
     "Implement a unified guest-profile system so all staff see full guest history",
     "2000 + (rooms * 8)", "3-4 months",
     "Personalised service; 35% reduction in repeat complaints from returning guests"),
    ("COMMUNICATION_BREAKDOWN", "long_term",
     "Establish a monthly all-staff town hall with guest-satisfaction transparency reports",
     "rooms * 2", "3 months to mature",
     "Builds service culture; staff who understand impact improve 20% faster"),
]
