"""Word lists, keyword dictionaries, patterns and domain tables.

Everything in this module is data.  The values decide which words, phrases and
thresholds an operator looks for, so they are stated in full and in their
natural order; the logic that uses them lives in ``functions`` and
``operators``.  All tables are small constants, whatever the size of the input.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# stopwords
# --------------------------------------------------------------------------
# General English list (the widely published 179-word list).
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve y
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
wouldn't
""".split()

# Short list of the "api" keyword variant.
API_STOPWORDS = """
the a an and or but in on at to for of with by from is was are were be been
this that it its i you he she we they
""".split()

# Extra words dropped by text cleaning, on top of the English list.
REVIEW_STOPWORDS = """
product amazon bought purchase ordered item one would get like use used also
really thing much well good
""".split()

# --------------------------------------------------------------------------
# Emotion dictionaries, per variant, in emotion order
# --------------------------------------------------------------------------
EMOTIONS = {
    "default": {
        "joy": ["happy", "joy", "love", "excellent", "amazing", "wonderful", "great", "perfect", "delighted"],
        "sadness": ["sad", "disappointed", "unhappy", "regret", "poor", "terrible", "awful", "bad"],
        "anger": ["angry", "annoyed", "frustrated", "furious", "hate", "worst", "horrible", "disgusting"],
        "fear": ["afraid", "worried", "concerned", "anxious", "scared", "nervous", "hesitant"],
        "surprise": ["surprised", "unexpected", "shocked", "amazed", "astonished", "wow"],
        "disgust": ["disgusting", "gross", "revolting", "repulsive", "nasty", "horrible"],
        "trust": ["trust", "reliable", "confident", "recommended", "authentic", "genuine", "verified"],
        "anticipation": ["excited", "looking forward", "can't wait", "anticipate", "expect", "hope"],
    },
    "api": {
        "joy": ["love", "amazing", "excellent", "happy", "wonderful", "fantastic", "great", "perfect"],
        "sadness": ["disappointed", "sad", "terrible", "awful", "horrible", "waste", "regret"],
        "anger": ["angry", "furious", "frustrated", "annoyed", "hate", "worst", "never"],
        "fear": ["worried", "concerned", "afraid", "unsafe", "dangerous", "risky", "careful"],
        "surprise": ["surprised", "unexpected", "wow", "shocked", "amazing", "incredible"],
        "disgust": ["disgusting", "gross", "nasty", "cheap", "garbage", "junk", "terrible"],
        "trust": ["reliable", "trustworthy", "quality", "recommend", "dependable", "solid"],
        "anticipation": ["excited", "can't wait", "looking forward", "will buy", "next time"],
    },
    "ensemble": {
        "joy": ["love", "amazing", "excellent", "happy", "wonderful", "fantastic",
                "delighted", "pleased", "perfect", "great", "awesome", "brilliant"],
        "sadness": ["disappointed", "sad", "unhappy", "terrible", "awful",
                    "depressed", "miserable", "unfortunate", "regret", "sorry"],
        "anger": ["angry", "furious", "annoyed", "frustrated", "irritated",
                  "mad", "outraged", "disgusted", "hate", "horrible"],
        "fear": ["scared", "afraid", "worried", "nervous", "anxious",
                 "frightened", "concerned", "unsafe", "dangerous", "risky"],
        "surprise": ["surprised", "shocked", "amazing", "unexpected",
                     "unbelievable", "astonished", "wow", "incredible"],
        "disgust": ["disgusting", "gross", "nasty", "awful", "revolting",
                    "repulsive", "horrible", "yuck", "terrible"],
        "trust": ["reliable", "trustworthy", "dependable", "confident",
                  "secure", "safe", "honest", "genuine", "authentic"],
        "anticipation": ["excited", "looking forward", "eager", "hopeful",
                         "expecting", "waiting", "can't wait", "anticipate"],
    },
    "free": {
        "joy": ["love", "amazing", "excellent", "great", "perfect", "wonderful",
                "fantastic", "happy", "delighted", "impressed", "outstanding"],
        "sadness": ["disappointed", "poor", "waste", "regret", "unhappy",
                    "terrible", "awful", "worst", "bad", "useless"],
        "anger": ["angry", "frustrated", "furious", "annoyed", "irritated",
                  "disgusted", "hate", "horrible"],
        "fear": ["worried", "concerned", "nervous", "afraid", "scared", "dangerous", "unsafe"],
        "surprise": ["unexpected", "surprised", "shocking", "amazing", "unbelievable", "wow"],
    },
}

# --------------------------------------------------------------------------
# Theme dictionaries, in theme order
# --------------------------------------------------------------------------
KEYWORD_THEMES = {
    "Quality": ["quality", "build", "material", "durable", "sturdy", "well made"],
    "Price": ["price", "expensive", "cheap", "value", "worth", "cost"],
    "Performance": ["performance", "works", "fast", "slow", "efficient", "speed"],
    "Delivery": ["delivery", "shipping", "arrived", "packaging", "package"],
    "Design": ["design", "look", "appearance", "style", "color", "beautiful"],
    "Size": ["size", "fit", "large", "small", "perfect fit"],
    "Easy to Use": ["easy", "simple", "convenient", "user friendly", "straightforward"],
}
THEME_POSITIVE_WORDS = ["great", "good", "excellent", "amazing", "love", "perfect", "best"]
THEME_NEGATIVE_WORDS = ["bad", "poor", "terrible", "waste", "disappointed", "not good"]

LABEL_THEMES = {
    "Quality": ["quality", "well-made", "durable", "sturdy"],
    "Price": ["price", "expensive", "cheap", "value", "worth"],
    "Performance": ["fast", "slow", "works", "broken", "reliable"],
    "Design": ["look", "design", "style", "color", "size"],
    "Shipping": ["delivery", "shipping", "arrived", "package"],
}

OCCURRENCE_THEMES = {
    "Product Quality": ["quality", "build", "material"],
    "Value for Money": ["price", "value", "worth"],
    "Customer Service": ["service", "support", "help"],
    "Shipping": ["delivery", "shipping", "package"],
    "Performance": ["works", "performance", "speed"],
}

ASPECT_THEMES = {
    "Quality": ["quality", "build", "material", "durable", "sturdy", "solid"],
    "Price": ["price", "expensive", "cheap", "value", "worth", "cost"],
    "Performance": ["performance", "works", "fast", "slow", "efficient", "speed"],
    "Delivery": ["delivery", "shipping", "arrived", "packaging", "package"],
    "Customer Service": ["service", "support", "customer", "help", "response"],
    "Features": ["feature", "function", "option", "capability", "easy", "difficult"],
    "Design": ["design", "look", "appearance", "style", "color", "size"],
}

PATTERN_THEMES = {
    "Quality & Performance": ["quality", "performance", "work", "function"],
    "Price & Value": ["price", "cost", "expensive", "cheap", "value"],
    "Delivery & Service": ["delivery", "shipping", "service", "customer"],
    "Ease of Use": ["easy", "simple", "use", "install", "setup"],
    "Design & Appearance": ["design", "look", "appearance", "color", "size"],
}
PATTERN_THEME_SCORE = 3.5
PATTERN_DEFAULT_THEME = "General Feedback"
PATTERN_DEFAULT_KEYWORDS = ["product", "experience", "purchase"]
PATTERN_DEFAULT_SCORE = 3.0

# Words that a cluster name skips, and the word groups that add a suffix.
CLUSTER_GENERIC_WORDS = ["product", "quality", "good", "great", "bad"]
CLUSTER_SUFFIXES = [
    ("Price", ["price", "cost", "expensive", "cheap"]),
    ("Delivery", ["delivery", "shipping", "fast", "slow"]),
    ("Usability", ["easy", "difficult", "simple", "complex"]),
]

# Theme names that ask for a recommendation.
NEGATIVE_THEME_MARKS = ["problem", "issue", "poor", "bad"]

# --------------------------------------------------------------------------
# Fake-review patterns and phrases
# --------------------------------------------------------------------------
SUSPICIOUS_TEXT_PATTERNS = [
    r"^great product!?$",
    r"^excellent!?$",
    r"^amazing!?$",
    r"^love it!?$",
    r"^perfect!?$",
    r"^highly recommend!?$",
    r"^five stars?!?$",
    r"^best buy!?$",
    r"^must have!?$",
    r"^super!?$",
]
GENERIC_PHRASES = [
    "great product", "excellent quality", "highly recommend", "very satisfied", "love it",
    "perfect", "as described", "fast shipping", "good value", "five stars",
]
SUSPICIOUS_AUTHOR_PATTERNS = [
    r"^customer\d+$",
    r"^user\d+$",
    r"^amazon\s?customer$",
    r"^\d+$",
    r"^reviewer\d*$",
    r"^[a-z]{1,2}\d+$",
]

# --------------------------------------------------------------------------
# Marketplaces, countries, product-code patterns
# --------------------------------------------------------------------------
# country -> (domain, display name or None); the order is the published one.
COUNTRY_DOMAINS = {
    "US": "amazon.com", "UK": "amazon.co.uk", "DE": "amazon.de", "FR": "amazon.fr",
    "ES": "amazon.es", "IT": "amazon.it", "CA": "amazon.ca", "IN": "amazon.in",
    "JP": "amazon.co.jp", "AU": "amazon.com.au", "BR": "amazon.com.br", "MX": "amazon.com.mx",
    "AE": "amazon.ae", "SG": "amazon.sg", "NL": "amazon.nl", "SE": "amazon.se",
}
# The live form knows the first nine of these, the dashboard form the first twelve.
COUNTRY_SETS = {
    "live": ["US", "UK", "DE", "FR", "IT", "ES", "CA", "IN", "JP"],
    "dashboard": ["US", "IN", "UK", "DE", "FR", "IT", "ES", "CA", "JP", "AU", "BR", "MX"],
    "service": list(COUNTRY_DOMAINS),
}
DEFAULT_DOMAIN = "amazon.com"
COUNTRY_NAMES = {
    "US": "United States", "IN": "India", "UK": "United Kingdom", "DE": "Germany", "FR": "France",
    "IT": "Italy", "ES": "Spain", "CA": "Canada", "JP": "Japan", "AU": "Australia", "BR": "Brazil",
    "MX": "Mexico",
}
MARKETPLACE_DOMAINS = [
    "amazon.com", "amazon.co.uk", "amazon.de", "amazon.fr", "amazon.it", "amazon.es", "amazon.ca",
    "amazon.com.au", "amazon.in", "amazon.co.jp", "amazon.com.br", "amazon.com.mx",
]
PRODUCT_PATHS = ["/dp/", "/gp/product/", "/product/", "/ASIN/"]
CODE_PATTERNS = {
    # strict: the code must also start with B
    "strict": [
        r"/dp/([A-Z0-9]{10})",
        r"/gp/product/([A-Z0-9]{10})",
        r"/product/([A-Z0-9]{10})",
        r"/ASIN/([A-Z0-9]{10})",
        r"[?&]asin=([A-Z0-9]{10})",
    ],
    # loose: any ten letters or digits
    "loose": [
        r"/dp/([A-Z0-9]{10})",
        r"/gp/product/([A-Z0-9]{10})",
        r"/product/([A-Z0-9]{10})",
        r"/dp/product/([A-Z0-9]{10})",
        r"/ASIN/([A-Z0-9]{10})",
        r"amazon\.[^/]+/.*?([A-Z0-9]{10})(?:[/?]|$)",
    ],
    # basic: the form without the ASIN path and the catch-all
    "basic": [
        r"/dp/([A-Z0-9]{10})",
        r"/gp/product/([A-Z0-9]{10})",
        r"/product/([A-Z0-9]{10})",
    ],
}
MULTI_COUNTRY_DEFAULT = ["US", "UK", "DE", "CA"]
COUNTRY_PRIORITY = ["IN", "US", "UK", "DE", "CA"]

# --------------------------------------------------------------------------
# Text of growth recommendations
# --------------------------------------------------------------------------
GROWTH_RECOMMENDATIONS = {
    "strong": "📈 Strong growth detected - consider increasing inventory",
    "declining": "📉 Declining sales - review pricing and competition",
    "consistent": "✅ Consistent growth pattern - maintain current strategy",
    "volatile": "⚠️ Volatile sales pattern - investigate causes",
    "monthly": "🚀 Excellent monthly performance - capitalize on momentum",
}
