"""Fixed values that results depend on: word lists, tables, patterns and templates."""

from __future__ import annotations

# --- Fixed values: lexicons of the message classifier -----------------------
# A word listed twice counts twice; words are matched as substrings of lower-case text.

SOCIAL_WORDS = {
    "urgency": ["urgent", "immediately", "quick", "hurry", "expire", "action required", "deadline", "जल्दी", "तुरंत", "अभी", "jaldi", "turant"],
    "fear": ["arrest", "court", "police", "cbi", "jail", "suspend", "penalty", "fine", "पुलिस", "जेल", "अदालत", "जुर्माना", "court", "band", "arrest"],
    "authority_impersonation": ["electricity board", "power department", "sbi bank", "manager", "support desk", "official", "बैंक", "मैनेजर", "बिजली विभाग", "सरकारी", "bijli"],
    "reward_bait": ["won", "lottery", "draw", "gift card", "reward points", "free cashback", "congratulations", "जीता", "इनाम", "लॉटरी", "मुफ्त", "jeeta", "inam", "lottery", "free"],
    "financial_pressure": ["bill due", "pay now", "pending payment", "unpaid", "arrears", "electricity bill", "बिल", "भुगतान", "बकाया", "पैसे", "paisa", "payment"],
}
INTENT_WORDS = {
    "fake_kyc": ["kyc", "verify", "pan card", "aadhaar", "verification", "अपडेट", "सत्यापन", "update"],
    "otp_theft": ["otp", "one time password", "code", "pin", "ओटीपी", "पासवर्ड"],
    "upi_fraud": ["upi", "gpay", "phonepe", "paytm", "send money", "request money", "पैसे भेजें", "UPI"],
    "job_scams": ["job offer", "work from home", "salary", "part time", "earn money", "नौकरी", "रोजगार", "kamao"],
    "delivery_scams": ["delivery", "courier", "package", "post office", "tracking", "डिलिवरी", "पार्सल", "post"],
}
BENIGN = "Legitimate / Benign"

# --- Fixed values: weak labels of the training corpus ------------------------

WEAK_SOCIAL_WORDS = {
    "urgency": ["urgent", "immediately", "immediate", "today", "24 hours", "24 ghante", "turant", "aaj raat", "expires", "expire", "hurry", "limited time", "limited period", "last day", "ends today", "12 hours", "तुरंत", "आज रात", "२४ घंटे", "अंतिम दिन", "जल्दी", "shighra"],
    "fear": ["block", "blocked", "suspend", "suspended", "freeze", "arrest", "police", "cyber crime", "crime branch", "jail", "penalty", "warning", "virus", "hacked", "cancel", "band ho", "sthagit", "ब्लॉक", "बंद", "स्थगित", "चेतावनी", "वायरस", "जुर्माना", "कार्रवाई", "गैर-जमानती"],
    "authority_impersonation": ["sbi", "hdfc", "icici", "axis", "kotak", "rbi", "cert-in", "cyber cell", "police", "customs", "income tax", "india post", "government", "sarkari", "telecom", "department of telecom", "trai", "parivahan", "msedcl", "bses", "uppcl", "bescom", "tsspdcl", "भारतीय स्टेट बैंक", "दूरसंचार विभाग", "भारत सरकार", "कस्टम्स", "बिजली विभाग", "यातायात पुलिस"],
    "reward_bait": ["won", "winner", "congratulations", "badhai", "lottery", "reward", "free", "cashback", "bonus", "inaam", "gift", "discount", "prize", "claim", "special offer", "बधाई", "इनाम", "लॉटरी", "कैशबैक"],
    "financial_pressure": ["loan", "debit card", "credit card", "credited", "debited", "transfer", "amount", "rs.", "inr", "rupees", "emi", "refund", "duty charges", "fee", "shulk", "bhugtan", "balance", "challan", "रुपये", "भुगतान", "शुल्क", "चालान"],
}
WEAK_INTENT_WORDS = {
    "Traffic e-Challan": ["challan", "parivahan", "traffic police", "यातायात पुलिस", "चालान", "vahan fine"],
    "Electricity Disconnection": ["electricity", "power bill", "light bill", "bijli", "बिजली बिल", "बिजली कनेक्शन", "msedcl", "bses", "uppcl", "bescom"],
    "Fake KYC": ["kyc", "pan card", "aadhaar", "update your kyc", "kyc suspend", "केवाईसी", "सत्यापन", "e-kyc"],
    "Courier Scam": ["customs", "parcel", "courier", "fedex", "warehouse", "delivery", "पार्सल", "कस्टम्स", "india post", "bluedart", "delhivery"],
    "Lottery / Prize": ["lottery", "winner", "kbc", "prize", "inaam", "लॉटरी", "इनाम", "बधाई", "7.5 lakh", "25 lakh", "dhan yojana"],
    "Telegram Job": ["job", "work from home", "daily salary", "part time job", "घर बैठे कमाई", "नौकरी", "youtube like", "hotel review"],
    "UPI Fraud": ["upi", "google pay", "gpay", "phonepe", "paytm", "cashback", "collect request", "कलेक्ट"],
    "Bank Account Freeze": ["account block", "account suspended", "account freeze", "khata block", "खाता ब्लॉक", "खाता स्थगित", "cbi", "cyber cell", "digital arrest", "money laundering"],
    "OTP / Credential Theft": ["otp", "verification code", "one time password", "passcode", "ओटीपी", "पिन"],
    "Loan Scam": ["loan", "personal loan", "pre-approved loan", "ऋण", "लोन"],
}
OTHER_INTENT = "General Spam / Telemarketing"
TRUTH_WORDS = ["scam", "block", "kyc", "inaam", "lottery", "winner", "loan", "virus", "apk", "customs", "duty"]
THREAT_WORDS_HI = ["बैंक", "खाता", "ब्लॉक", "सस्पेंड", "केवाईसी", "बिजली", "बिल", "चालान", "पुलिस", "लॉटरी", "इनाम", "कैशबैक", "रिफंड", "लिंक", "ओटीपी", "पासवर्ड", "चेतावनी", "तुरंत", "अपडेट", "ऋण", "लोन", "सीमा शुल्क", "कस्टम्स", "पार्सल", "गिरफ्तारी", "वारंट", "रुपये", "पैसा", "जीत"]

# --- Fixed values: language identification -----------------------------------

STRONG_INDIC_WORDS = ["aapka", "aapke", "aapko", "apna", "apne", "apni", "karein", "kare", "karo", "karna", "kijiye", "krwalo", "kardo", "turant", "dhokhadhadi", "bijli", "challan", "parivahan", "khata", "khate", "inaam", "badhai", "paise", "paisa", "rupaye", "rupay", "dhanyawad", "chahiye", "chalega", "adhikari", "sambandhit", "suvidha", "bhugtan", "mubarak", "yojana", "sarkari", "suchna", "warna", "varna", "kripya", "sahab", "shulk", "jama", "paayein", "sampark", "jaldi"]
INDIC_PARTICLES = ["hai", "hain", "hoga", "hogi", "hoge", "gaya", "gayi", "gaye", "nahi", "nahin", "mat", "bheja", "bheje", "bhejo", "raha", "rahe", "rahi", "rha", "rhi", "mujhe", "mera", "meri", "mere", "tera", "teri", "tere", "humara", "humare", "bhai", "beta", "papa", "pata", "baat", "karta", "karti", "karte", "liye", "wala", "wali", "wale", "hua", "hui", "hue"]
HINGLISH_MARKERS = ["aapka", "aapke", "aapko", "apna", "apne", "apni", "karein", "kare", "karo", "karna", "kijiye", "kro", "krwalo", "kardo", "hoga", "hogi", "hoge", "hua", "hui", "hue", "turant", "jaldi", "shighra", "khata", "khate", "paisa", "paise", "rupaye", "rupay", "bhejo", "bheja", "bheje", "diya", "liye", "aaj", "raat", "kal", "shaam", "sampark", "band", "dhokhadhadi", "hai", "hain", "ho", "nahi", "nahin", "mat", "varna", "warna", "yojana", "inaam", "mubarak", "badhai", "bijli", "sarkari", "police", "challan", "shulk", "jama", "bhugtan", "kripya", "dhanyawad", "chahiye", "raha", "rahe", "rahi", "rha", "rhi", "mujhe", "mera", "meri", "mere", "tera", "teri", "tere", "humare", "humara", "bhai", "beta", "papa", "sahab", "suchna", "adhikari"]
HINGLISH_STRONG = ["aapka", "karein", "turant", "khata", "dhokhadhadi", "yojana", "inaam", "badhai", "bijli", "sarkari", "challan", "bhugtan"]
INDIC_CORE_WORDS = ["hai", "hain", "ho", "karein", "kare", "karo", "karna", "kijiye", "kro", "hoga", "hogi", "hoge", "hua", "hui", "hue", "aapka", "aapke", "aapko", "apna", "apne", "apni", "nahi", "nahin", "mat", "bhejo", "bheja", "bheje", "khata", "khate", "raat", "aaj", "kal", "turant", "jaldi", "paayein", "sampark", "yojana", "inaam", "badhai", "bijli", "sarkari", "police", "challan", "paisa", "paise", "rupaye", "rupay", "shulk", "jama", "bhugtan", "dhokhadhadi", "varna", "warna", "band", "kripya", "dhanyawad", "chahiye", "raha", "rahe", "rahi", "rha", "rhi", "mujhe", "mera", "meri", "mere", "tera", "teri", "tere", "humare", "humara", "bhai", "beta", "papa"]
AMBIGUOUS_WORDS = ["me", "to", "in", "on", "at", "lo", "le", "leh", "se", "pe", "ko", "ka", "ki", "ke", "par", "do"]
MARATHI_WORDS = ["आहे", "नाही", "आहेत", "करून", "केले", "साठी", "यांनी", "त्यांनी", "केला", "केली", "झाला", "झाली", "भेटला", "बघून"]
#: Characters stripped from the ends of a token before it is looked up.
TOKEN_EDGE = ".,!?:;\"'()[]{}<>-/\\#@$%^&*~`"

# --- Fixed values: brands, hosts and lures ------------------------------------

BRANDS = ["sbi", "hdfc", "icici", "axis", "kotak", "pnb", "bob", "hsbc", "paytm", "phonepe", "bhim", "gpay", "paypal", "yono", "onlinesbi", "jio", "airtel", "vi", "bsnl", "vodafone", "amazon", "flipkart", "netflix", "google", "microsoft", "apple", "uidai", "pan", "incometax", "epfo", "indiapost"]
#: Replacements of look-alike characters, applied one after another in this order.
LOOK_ALIKES = [("0", "o"), ("1", "i"), ("l", "i"), ("vv", "w"), ("rn", "m"), ("cl", "d"), ("cj", "g"), ("i", "l"), ("o", "0")]
BANK_NAMES = ["HDFC", "SBI", "ICICI", "AXIS", "KOTAK", "PAYTM", "RBI", "PNB", "BOB", "HSBC", "JIO", "AIRTEL"]
HOST_LURES = ["free", "reward", "win", "gift", "login", "kyc", "verify", "pay"]
PAGE_LURES = ["login", "kyc", "verify", "pay", "secure", "bank"]
BAD_TLS = ["invalid", "expired", "hostname_mismatch", "self_signed"]
LOCAL_HOSTS = ["localhost", "127.0.0.1", "::1"]

# --- Fixed values: text patterns (Java syntax) --------------------------------
# Words are letters, numbers and "_"; white space is Unicode white space.

SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = r"[^\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
TLDS = "com|org|net|in|gov|edu|xyz|co|io|ly|me|top|site|live|info|biz|online|app|page|ke|ng|ai|ph|cc|club|shop|store|vip|pro|icu"
_URL_CHAR = r"""[^\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000},;!?"'\)\]}]"""
URL = rf"(?iu)https?://{_URL_CHAR}+|www\.{_URL_CHAR}+|[a-zA-Z0-9\-]+\.(?:{TLDS})(?:/{_URL_CHAR}*)?"
#: Steps that heal wrapped and split URLs: rounds, then (pattern, replacement) pairs that are applied in turn in each round.
STITCH_STEPS = [
    (1, [
        (r"(https?://|www\.)[ \t]*\n[ \t]*", "$1"),
        (r"(https?://)[ \t]+", "$1"),
        (r"(www\.)[ \t]+", "$1"),
    ]),
    (5, [
        (rf"(?iu)((?:https?://|www\.)[^\n]*?[\p{{L}}\p{{N}}_\-/]+-)[ \t]*\n[ \t]*([a-zA-Z0-9])", "$1$2"),
        (r"(?iu)([a-zA-Z0-9\-_./]+-)[ \t]*\n[ \t]*([a-zA-Z0-9])", "$1$2"),
        (rf"(?iu)((?:https?://|www\.){NOT_SPACE}*?/{NOT_SPACE}*?[a-zA-Z0-9])[ \t]*\n[ \t]*([a-zA-Z0-9_\-./]+\.[a-zA-Z0-9]+|[a-zA-Z0-9_\-/]+(?:{SPACE}|$))", "$1$2"),
    ]),
    (5, [
        (rf"(?iu)((?:https?://|www\.){NOT_SPACE}*?[\p{{L}}\p{{N}}_\-]+-)[ \t]+([\p{{L}}\p{{N}}_\-]+)", "$1$2"),
        (r"(?iu)([\p{L}\p{N}_\-]+-)[ \t]+([\p{L}\p{N}_\-]+(?:\.[\p{L}\p{N}_\-]+|/))", "$1$2"),
    ]),
    (1, [
        (r"(/[a-zA-Z0-9\-_]+)[ \t]+(/[a-zA-Z0-9\-_]+)", "$1$2"),
        (r"([a-zA-Z0-9\-]+\.[a-zA-Z]{2,}/)[ \t]+([a-zA-Z0-9\-_]+)", "$1$2"),
        (r"/[ \t]+([a-zA-Z0-9\-_]+)", "/$1"),
    ]),
]
HEAL_STEPS = [
    (1, [
        (r":(?=[a-zA-Z0-9\-]+\.[a-zA-Z]{2,})", ": "),
        (r"(https?://)[ \t]+", "$1"),
        (r"(www\.)[ \t]+", "$1"),
        (r"([a-zA-Z0-9\-]+\.[a-zA-Z]{2,}/)[ \t]+([a-zA-Z0-9\-_]+)", "$1$2"),
        (r"/[ \t]+([a-zA-Z0-9\-_]+)", "/$1"),
    ]),
    (3, [
        (r"([a-zA-Z0-9\-]+-)[ \t]+([a-zA-Z0-9\-]+(?:\.[a-zA-Z]{2,}))", "$1$2"),
        (r"([a-zA-Z0-9\-]+-)[ \t]+([a-zA-Z0-9\-]+(?:/[a-zA-Z0-9\-_]+))", "$1$2"),
        (r"([a-zA-Z0-9\-]+-)[ \t]+([a-zA-Z0-9\-]+-)", "$1$2"),
    ]),
]
URL_REPAIRS = [("https:II", "https://"), ("http:II", "http://"), ("https:l/", "https://"), ("http:l/", "http://"), ("https:1/", "https://"), ("http:1/", "http://"), ("https:// ", "https://"), ("http:// ", "http://"), ("bit.Iy", "bit.ly"), ("bit.IY", "bit.ly"), ("bit.lyI", "bit.ly/")]
URL_TAIL = r"[.,;!?)\]}>]+$"
NATIONAL_ID = rf"{EDGE}\p{{Nd}}{{4}}{SPACE}\p{{Nd}}{{4}}{SPACE}\p{{Nd}}{{4}}{EDGE}"
NATIONAL_ID_MASK = "[Aadhaar Redacted]"
UPI_ID = rf"{EDGE}[a-zA-Z0-9.\-_]+@[a-zA-Z]{{2,}}{EDGE}"
PHONE = rf"{EDGE}(?:\+91|91|0)?[6-9]\p{{Nd}}{{9}}{EDGE}"
CODE = rf"{EDGE}\p{{Nd}}{{4,6}}{EDGE}"
AMOUNT = rf"(?iu)(?:INR|Rs\.?|₹|rs\.?){SPACE}*(\p{{Nd}}+(?:,\p{{Nd}}+)*(?:\.\p{{Nd}}{{1,2}})?)"
DEVANAGARI = r"[ऀ-ॿ]"
_FLAG_TLDS = "com|org|net|in|xyz|me|online|top|site|live|co|info|biz|apk|app|page|tk|ml"
_TWO_HALVES = rf"{EDGE}\p{{Nd}}{{5}}(?:-|{SPACE})?\p{{Nd}}{{5}}{EDGE}"
FLAGS = {
    "has_url": rf"(?iu)https?://{NOT_SPACE}+|www\.{NOT_SPACE}+|[a-zA-Z0-9\-]+\.(?:{_FLAG_TLDS}|ly|io)(?:/{NOT_SPACE}*)?",
    "has_phone": rf"{PHONE}|{_TWO_HALVES}",
    "has_otp": rf"(?iu){EDGE}(?:otp|one time password|verification code|pin|passcode|ओटीपी|पिन){EDGE}",
    "has_upi": UPI_ID,
    "has_amount": rf"(?iu)(?:INR|Rs\.?|₹|rs\.?|\$|£){SPACE}*(\p{{Nd}}+(?:,\p{{Nd}}+)*(?:\.\p{{Nd}}{{1,2}})?)",
}
SYNTHETIC_FLAGS = FLAGS | {
    "has_url": rf"(?iu)https?://{NOT_SPACE}+|www\.{NOT_SPACE}+|[a-zA-Z0-9\-]+\.(?:{_FLAG_TLDS})(?:/{NOT_SPACE}*)?",
    "has_phone": PHONE,
    "has_amount": AMOUNT,
}
TEMPLATE_STEPS = [
    (rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+|{NOT_SPACE}+\.(?:com|org|net|in|xyz|top|online|site){NOT_SPACE}*", "<URL>"),
    (rf"{PHONE}|{_TWO_HALVES}", "<PHONE>"),
    (rf"(?:inr|rs\.?|₹){SPACE}*\p{{Nd}}+(?:,\p{{Nd}}+)*(?:\.\p{{Nd}}+)?", "<AMOUNT>"),
    (rf"{EDGE}\p{{Nd}}+{EDGE}", "<NUM>"),
    (r"[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}ऀ-ॿ]", " "),
    (rf"{SPACE}+", " "),
]

# --- Fixed values: creation dates of domains -----------------------------------

DATE_FORMATS = ["yyyy-M-d H:m:s", "yyyy-M-d H:m:s z", "d-M-yyyy", "d/M/yyyy", "MMM d yyyy", "d-MMM-yyyy", "d MMM yyyy"]

# --- Fixed values: unsafe networks ----------------------------------------------
# Loopback, private, link-local, multicast, unspecified and reserved ranges, and explicitly blocked ones.

UNSAFE_V4 = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
UNSAFE_V6 = ["::/128", "::1/128", "::/8", "64:ff9b:1::/48", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "fec0::/10", "ff00::/8"]
PRIVATE_V4 = ["0.0.0.0/8", "10.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]

# --- Fixed values: screenshot blocks ---------------------------------------------

UI_TEXTS = ["delete", "mark as known", "mark as read", "forward", "copy", "block", "report spam", "sms", "text message", "business account", "voice call", "silenced voice call", "unknown caller", "joined last month", "हटाएं", "ब्लॉक", "रिपोर्ट", "स्पैम"]
STATUS_BAR = [r"^\p{Nd}{1,2}:\p{Nd}{2}$", r"^\p{Nd}{1,3}%$", rf"(?iu)^(LTE|4G|5G|VoLTE|SIM{SPACE}?\p{{Nd}}?)$"]
SHORTHAND = {"mujs": "mujhse", "kr": "kar", "kro": "karo", "kr do": "kar do", "pls": "please", "plz": "please", "bt": "baat", "msg": "message", "bcz": "because", "abt": "about", "wid": "with", "ur": "your", "r u": "are you", "u r": "you are", "frm": "from", "thn": "then", "nw": "now", "tmrw": "tomorrow", "nd": "and", "dn": "done", "bhejo": "send", "abhi kro": "abhi karo", "help kro": "help karo", "call me": "call me", "turant": "immediately", "jaldi": "quickly", "abhi": "now"}
RANK_URGENCY = ["urgent", "immediately", "quickly", "now", "turant", "jaldi", "alert", "warning", "suspend", "block"]
RANK_AUTHORITY = ["police", "bank", "manager", "rbi", "government", "sbi", "hdfc", "icici", "axis"]
MIN_CONFIDENCE, MIN_OVERLAP, LINE_GAP = 0.55, 0.50, 15

# --- Fixed values: scores ---------------------------------------------------------

WEIGHTS = {"ML": 0.40, "URL": 0.25, "Domain": 0.20, "Sandbox": 0.15}
FAILED_SANDBOX = ["hostile_timeout", "failed", "skipped"]
CATEGORY_HI = {"Safe": "सुरक्षित (Safe)", "Suspicious": "संदिग्ध (Suspicious)", "High Risk": "अत्यंत जोखिम (High Risk)"}

# Sentences of imitation of brands and of checks before a page is opened, with their places to fill.
SQUAT_INSIDE = "Domain contains trusted brand name '{brand}' in suspicious context."
SQUAT_NEAR = "Domain SLD '{label}' is highly similar to brand '{brand}' (edit distance: {distance})."
SQUAT_LIKE = "Domain SLD '{label}' visually mimics brand '{brand}' using homoglyphs."
SQUAT_NONE = "No typosquatting detected."
URL_EMPTY = "Empty or invalid URL type"
URL_NO_SCHEME = "Missing URL scheme"
URL_BAD_SCHEME = "Disallowed URL scheme: {scheme}"
URL_NO_HOST = "Missing hostname in URL"
URL_BAD_PORT = "Malformed port in URL"
DNS_LATE = "DNS resolution timed out"
DNS_EMPTY = "DNS resolution returned no IP addresses"
DNS_FAILED = "DNS resolution failed"
DNS_UNSAFE = "Hostname resolves to unsafe IP address: {ip}"
URL_SAFE = "URL is safe for sandbox execution"
