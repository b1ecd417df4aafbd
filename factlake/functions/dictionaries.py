"""Word lists, patterns and tables whose content decides results. Order matters where lists are searched first to last."""

from __future__ import annotations

# Words whose period ends no sentence.
ABBREVIATIONS = (
    "mr mrs dr prof sr jr ltd inc co corp llc lp plc etf fof amc auml nav sip sid ppfas mf nfo mtf pe rsi y yr yrs "
    "jan feb mar apr jun jul aug sep oct nov dec st nd rd th no vs eg ie etc pvt"
).split()

# Chunk types and the phrases that tell them; the first type with a hit wins.
CHUNK_TYPES = (
    ("expense_ratio", ("expense ratio",)),
    ("exit_load", ("exit load",)),
    ("min_sip", ("minimum sip", "min. for sip", "min for sip", "sip investment")),
    ("min_lumpsum", ("minimum lumpsum", "min. for lumpsum", "min for 1st investment", "min for 2nd investment")),
    ("nav", ("latest nav", "nav as of", "nav:")),
    ("aum", ("asset under management", "fund size (aum)", "total aum")),
    ("benchmark", ("fund benchmark", "benchmark")),
    ("risk_level", ("risk.", "rated", "riskometer", "very high risk", "high risk", "low risk")),
    ("fund_manager", ("fund manager", "managed by", "current fund manager")),
    ("inception_date", ("inception", "launch date", "date of incorporation", "made available to investors on")),
    ("category", ("equity mutual fund", "debt mutual fund", "hybrid mutual fund", "commodities mutual fund")),
    ("investment_objective", ("investment objective", "seeks to provide", "objective")),
    ("fund_house", ("fund house", "mutual fund house")),
    ("holdings", ("holdings", "holding analysis", "portfolio")),
    ("returns", ("annualised returns", "absolute returns", "fund returns", "returns and rankings")),
    ("tax", ("tax implication", "capital gains tax", "ltcg", "stcg")),
    ("stamp_duty", ("stamp duty",)),
)

# Phrases of navigation and footers, and phrases that protect a sentence from counting as such.
NOISE = (
    "invest in stocks", "etf screener", "ipo track", "stock screener", "demat account", "share market today", "terminal track", "option chain",
    "api trading", "mutual fund houses", "nfo's track", "sip calculator", "brokerage calculator", "margin calculator", "swp calculator", "pricing brokerage",
    "privacy policy", "terms and conditions", "disclosure", "information security", "investor charter", "bug bounty", "sitemap", "about us",
    "careers", "blog", "media & press", "help & support", "trust & safety", "download the app", "contact us", "show more",
    "others:", "top gainers", "top losers", "most traded", "market calender", "stocks feed", "share market live", "fii dii activity",
)
PROTECTED = ("expense ratio", "latest nav", "nav as of", "nav:", "fund size (aum)", "total aum", "min. for sip", "exit load")

# Fact type, pattern, confidence; the first match of a text is the fact.
FACT_PATTERNS = (
    ("expense_ratio", r"(?is)Expense ratio[:\s\n]+([0-9.]+)%", "HIGH"),
    ("nav", r"(?is)NAV[:\s\n]+(?:.*?)(?:₹|[\?])\s*([0-9,.]+)", "HIGH"),
    ("aum", r"(?is)(?:Fund size|AUM)[:\s\n\(\)]+(?:.*?)(?:₹|[\?])\s*([0-9,.]+)\s*Cr", "HIGH"),
    ("min_sip", r"(?is)Minimum SIP[:\s\n]+(?:.*?)(?:₹|[\?])\s*([0-9,.]+)", "HIGH"),
    ("min_lumpsum", r"(?is)Minimum Lumpsum[:\s\n]+(?:.*?)(?:₹|[\?])\s*([0-9,.]+)", "HIGH"),
    ("exit_load", r"(?is)Exit load[:\s\n]+.*?([0-9.]+%)(?:,\s*if redeemed within\s*([^.;\n]+))?", "HIGH"),
    ("benchmark", r"(?i)Benchmark[:\s\n]+([A-Za-z0-9\s\-\(\)]+?)(?:\n|$)", "HIGH"),
    ("inception_date", r"(?i)Inception.*?(\d{1,2}\s+[A-Za-z]{3}\s+\d{4})", "MEDIUM"),
    ("fund_manager", r"(?i)Fund Manager[:\s\n]+([A-Z][a-zA-Z\s]+)", "MEDIUM"),
    ("risk_level", r"(?i)([A-Za-z\s]+?)\s*risk", "MEDIUM"),
)
MONEY_FACTS = ("nav", "aum", "fund_size_cr", "min_sip", "min_lumpsum", "total_aum")

# Currency signs that are written as ₹.
CURRENCY_SIGNS = r"[\$\u00A2-\u00A5\u09F2\u09F3\u0AF1\u0BF9\u0E3F\u17DB\u20A0-\u20CF\uA838\uFDFC\uFE69\uFF04\uFFE5\uFFE6]"

# Patterns of personal data, in the order of the result.
PERSONAL_DATA = (
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("AADHAAR", r"\b\d{4}\s?\d{4}\s?\d{4}\b"),
    ("ACCOUNT_NUMBER", r"\b\d{9,18}\b"),
    ("OTP", r"(?i)\botp\b[:\s-]*\d{4,6}|\d{4,6}[:\s-]*\botp\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"(?:\+91[\s-]?)?[6-9]\d{9}\b"),
)

# Triggers of advisory and of factual questions, matched on small letters.
URL = r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2})|[/?:@!$&'()*+,;=._~-])+"
ADVISORY = (r"\bshould\b", r"\bbetter\b", r"\bbest\b", r"\brecommend\b", r"\bsafe\b", r"\boutperform\b", "invest now", r"\bbuy\b", r"\bsell\b")
FACTUAL = (
    "expense ratio", "exit load", "minimum sip", "min sip", "minimum lumpsum", "min lumpsum", "benchmark", "riskometer", "risk level", "nav", "aum",
    "asset under management", "fund manager", "who manages", r"\bmanager\b", "inception date", "launch date", "category", "tax", "taxation", "holdings",
    "portfolio", "stocks", "sector", "performance", "returns", "investment objective", "objective", "fund size", "total aum", "who", "tell me about", "information on",
)

# Spoken or misspelt term and what it stands for; applied longest first, equal lengths in this order.
SYNONYMS = (
    ("sip", "systematic investment plan"), ("nav", "net asset value"), ("aum", "assets under management"), ("ter", "total expense ratio"),
    ("expense", "expense ratio"), ("expanse ratio", "expense ratio"), ("expanse", "expense ratio"), ("charges", "expense ratio"), ("fees", "expense ratio"), ("cost", "expense ratio"),
    ("exit load", "exit load"), ("exit charges", "exit load"), ("exit charge", "exit load"), ("excit load", "exit load"), ("redemption fee", "exit load"),
    ("minimum sip", "min sip"), ("min sip", "min sip"), ("sip amount", "min sip"), ("lumpsum", "min lumpsum"), ("lumpsome", "min lumpsum"), ("lumsum", "min lumpsum"), ("min lumpsum", "min lumpsum"),
    ("inception date", "inception date"), ("launch date", "inception date"), ("start date", "inception date"), ("started on", "inception date"),
    ("riskometer", "riskometer"), ("risk level", "riskometer"), ("risk", "riskometer"), ("returns", "returns"), ("performance", "returns"), ("yield", "returns"),
    ("benchmark", "benchmark"), ("index", "benchmark"), ("standard", "benchmark"), ("etf", "exchange traded fund"), ("fof", "fund of funds"),
    ("ltcg", "long term capital gains"), ("stcg", "short term capital gains"), ("cagr", "compounded annual growth rate"), ("expense ratio", "total expense ratio"),
    ("wealth company", "the wealth company"), ("wealthco", "the wealth company"), ("twc", "the wealth company"), ("smallcap", "small cap fund"), ("small cap", "small cap fund"), ("smalcap", "small cap fund"),
    ("ethical", "ethical fund"), ("ethics fund", "ethical fund"), ("multi asset", "multi asset allocation fund"), ("multiasset", "multi asset allocation fund"),
    ("flexicap", "flexi cap fund"), ("flexi cap", "flexi cap fund"), ("flexy cap", "flexi cap fund"), ("liquid", "liquid fund"), ("liqid", "liquid fund"), ("arbitrage", "arbitrage fund"), ("arbitage", "arbitrage fund"),
    ("icici", "icici prudential"), ("icici pru", "icici prudential"), ("pru", "icici prudential"), ("icci", "icici prudential"), ("icici prudental", "icici prudential"),
    ("silver etf", "silver etf fof"), ("silver fof", "axis silver fof"), ("largecap", "large cap fund"), ("large cap", "large cap fund"), ("bharat 22", "bharat 22 fof"), ("bharat22", "bharat 22 fof"),
    ("dynamic plan", "dynamic plan"), ("dynamic fund", "dynamic plan"), ("technology", "technology fund"), ("tech fund", "technology fund"), ("it fund", "technology fund"),
    ("nifty next 50", "nifty next 50 index fund"), ("next 50", "nifty next 50 index fund"), ("top 100", "top 100 fund"), ("gold fund", "gold etf fof"), ("gold fof", "gold etf fof"),
    ("infrastructure", "infrastructure fund"), ("infra fund", "infrastructure fund"), ("pharma", "pharma healthcare and diagnostics (p.h.d) fund"), ("healthcare", "pharma healthcare and diagnostics (p.h.d) fund"),
    ("phd fund", "pharma healthcare and diagnostics (p.h.d) fund"), ("pharma fund", "pharma healthcare and diagnostics (p.h.d) fund"),
    ("axis", "axis"), ("aksis", "axis"), ("axes", "axis"), ("axis silver", "axis silver fof"),
)

# How a question names a fact type; the longest name wins, equal lengths in this order.
FACT_NAMES = (
    ("expense ratio", "expense_ratio"), ("charges", "expense_ratio"), ("fees", "expense_ratio"), ("cost", "expense_ratio"), ("exit load", "exit_load"), ("redemption fee", "exit_load"), ("exit charge", "exit_load"),
    ("min sip", "min_sip"), ("minimum sip", "min_sip"), ("systematic investment plan", "min_sip"), ("sip amount", "min_sip"), ("min lumpsum", "min_lumpsum"), ("minimum lumpsum", "min_lumpsum"), ("lumpsum amount", "min_lumpsum"),
    ("benchmark", "benchmark"), ("nav", "nav"), ("net asset value", "nav"), ("aum", "aum"), ("assets under management", "aum"), ("asset under management", "aum"), ("fund size", "aum"),
    ("riskometer", "risk_level"), ("risk level", "risk_level"), ("risk", "risk_level"), ("fund manager", "fund_manager"), ("manager", "fund_manager"), ("inception date", "inception_date"), ("launch date", "inception_date"),
    ("category", "category"), ("tax", "tax"), ("taxation", "tax"), ("holdings", "holdings"), ("portfolio", "holdings"), ("investment objective", "investment_objective"), ("objective", "investment_objective"), ("overview", "overview"), ("total aum", "total_aum"),
)
COMPARISONS = ("better", "worse", "superior", "inferior", "compare", "comparison", "versus", "vs", "difference", "diff")

# Phrases that an answer may not hold, by category.
BANNED = (
    ("prescriptive", ("you should", "you must", "i recommend", "it is advised", "your best option")),
    ("comparative", ("better than", "worse than", "superior to", "inferior to", "beats the")),
    ("evaluative", ("good investment", "bad investment", "too risky", "safe bet")),
    ("predictive", ("will go up", "will go down", "guaranteed returns", "expected to grow", "future performance")),
    ("action_oriented", ("buy now", "sell immediately", "invest today", "don't invest")),
    ("recommendation", ("my advice", "highly recommended", "top pick", "best fund")),
)

# Openings of sentences that lean on the sentence before.
DEPENDENT = ("it is", "they are", "this is", "that is", "these are", "those are", "which is", "who is")
