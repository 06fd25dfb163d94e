"""The controlled vocabulary: industries, locations, regions, topics, revenue buckets.

Fixed values: canonical names, their order, the phrases that name them, the
buckets' bounds and the word lists decide results, and so stand here as they are.
"""

from __future__ import annotations

from entitylens.functions.text import normalize, tokens

# Fixed values.
INDUSTRY_PHRASES = {
    "Fintech": ["fintech", "fin tech", "financial technology", "financial services", "finance", "financial", "banking", "bank", "payments company", "insurtech"],
    "Healthcare": ["healthcare", "health care", "health", "healthtech", "health tech", "medical", "medtech", "med tech", "clinical", "hospital", "care"],
    "Biotech": ["biotech", "bio tech", "biotechnology", "life science", "life sciences", "pharma", "pharmaceutical", "pharmaceuticals", "genomics", "bioscience"],
    "Technology": ["technology", "tech", "software", "saas", "cloud", "computing", "developer tools", "devtools", "infrastructure software", "information technology", "it services"],
    "Energy": ["energy", "utilities", "utility", "power", "cleantech", "clean tech", "renewables", "greentech", "green tech", "grid"],
    "Retail": ["retail", "ecommerce", "e commerce", "commerce", "consumer", "merchandising", "shopping", "stores"],
    "Education": ["education", "edtech", "ed tech", "learning", "training", "academic", "schools", "university", "e learning"],
    "Telecom": ["telecom", "telecoms", "telecommunications", "telco", "carrier", "mobile network", "network operator", "connectivity"],
    "Automotive": ["automotive", "auto", "car", "cars", "vehicle", "vehicles", "mobility", "autotech"],
    "Logistics": ["logistics", "supply chain", "shipping", "freight", "transport", "transportation", "delivery", "fulfilment", "fulfillment", "warehousing"],
}
LOCATION_PHRASES = {
    "Finland": ["finland", "finnish", "fi", "fin", "helsinki"],
    "Germany": ["germany", "german", "de", "deu", "ger", "deutschland", "berlin", "munich"],
    "France": ["france", "french", "fr", "fra", "paris"],
    "Norway": ["norway", "norwegian", "nor", "oslo"],
    "Sweden": ["sweden", "swedish", "se", "swe", "stockholm"],
    "Netherlands": ["netherlands", "the netherlands", "dutch", "nl", "nld", "holland", "amsterdam"],
    "USA": ["usa", "us", "u s", "u s a", "united states", "united states of america", "america", "american", "states"],
    "UK": ["uk", "u k", "united kingdom", "britain", "great britain", "british", "england", "english", "scotland", "wales", "gb", "gbr", "london"],
}
REGIONS = {
    "nordic": ["Finland", "Norway", "Sweden"],
    "nordics": ["Finland", "Norway", "Sweden"],
    "scandinavia": ["Norway", "Sweden"],
    "scandinavian": ["Norway", "Sweden"],
    "dach": ["Germany"],
    "benelux": ["Netherlands"],
    "europe": ["Finland", "France", "Germany", "Netherlands", "Norway", "Sweden", "UK"],
    "european": ["Finland", "France", "Germany", "Netherlands", "Norway", "Sweden", "UK"],
    "eu": ["Finland", "France", "Germany", "Netherlands", "Norway", "Sweden"],
}
TOPICS_OF = {
    "Fintech": {
        "fraud detection": ["fraud", "fraud prevention", "anti fraud", "fraud analytics", "risk assessment", "financial crime", "aml", "anti money laundering"],
        "banking analytics": ["banking", "bank analytics", "financial analytics", "digital banking", "banking intelligence", "financial data"],
        "payments": ["payment", "payment processing", "payments infrastructure", "transactions", "checkout", "money transfer"],
        "lending": ["loans", "loan", "credit", "credit scoring", "underwriting", "mortgages"],
    },
    "Healthcare": {
        "diagnostics": ["diagnostic", "diagnosis", "medical imaging", "screening", "pathology"],
        "patient monitoring": ["patient care", "remote monitoring", "vital signs", "telemedicine", "patient tracking"],
        "health data": ["health records", "ehr", "emr", "medical records", "health analytics", "clinical data", "health data analysis"],
    },
    "Biotech": {
        "drug discovery": ["drug development", "drug design", "pharmaceutical research", "compound discovery", "therapeutics"],
        "gene editing": ["crispr", "genome editing", "genetic engineering", "gene therapy", "genomics"],
        "molecular analysis": ["molecular", "proteomics", "molecular modelling", "molecular modeling", "compound analysis", "biotech research"],
    },
    "Technology": {
        "data pipelines": ["data pipeline", "etl", "elt", "data engineering", "data infrastructure", "streaming data", "data platform"],
        "observability": ["monitoring", "telemetry", "logging", "tracing", "apm", "instrumentation"],
        "cloud infrastructure": ["cloud platform", "cloud computing", "devops", "platform engineering", "kubernetes", "containers", "developer tools", "serverless"],
    },
    "Energy": {
        "energy forecasting": ["energy prediction", "load forecasting", "demand response", "power forecasting", "renewable forecasting"],
        "renewable energy": ["renewables", "solar", "wind", "clean energy", "green energy", "sustainability"],
        "smart grid": ["smart grids", "grid", "grid optimization", "grid optimisation", "grid management", "distribution network"],
    },
    "Retail": {
        "pricing optimization": ["pricing", "pricing optimisation", "price optimization", "dynamic pricing", "revenue management", "markdown"],
        "demand forecasting": ["demand planning", "sales forecasting", "demand prediction"],
        "inventory planning": ["inventory", "stock management", "assortment planning", "replenishment", "merchandising"],
    },
    "Education": {
        "personalized learning": ["personalised learning", "adaptive learning", "individualized learning", "tailored learning", "learning paths"],
        "student analytics": ["student data", "learning analytics", "student performance", "student outcomes", "academic analytics"],
    },
    "Telecom": {
        "5g analytics": ["5g", "five g", "5 g", "mobile analytics", "radio analytics", "5g networks"],
        "network optimization": ["network optimisation", "network performance", "ran optimization", "traffic optimization", "network planning"],
    },
    "Automotive": {
        "autonomous driving": ["self driving", "autonomous vehicles", "adas", "driverless", "sensor fusion", "autonomy"],
        "vehicle telemetry": ["connected car", "connected vehicles", "fleet telematics", "telematics", "vehicle data"],
    },
    "Logistics": {
        "route optimization": ["route optimisation", "routing", "route planning", "last mile", "dispatch", "fleet routing"],
        "supply chain visibility": ["supply chain", "shipment tracking", "freight visibility", "logistics visibility", "track and trace"],
    },
}
REVENUE_BUCKETS = {
    "0-1M": (0.0, 1e6),
    "1M-10M": (1e6, 1e7),
    "10M-50M": (1e7, 5e7),
    "50M-100M": (5e7, 1e8),
    "100M-500M": (1e8, 5e8),
    "500M+": (5e8, float("inf")),
}
#: Openings of generated descriptions; their words tell nothing about a company.
HEAD_MODIFIERS = ["AI-powered", "data-driven", "machine learning", "real-time", "cloud-native", "automated", "distributed", "predictive"]
HEAD_NOUNS = ["platform", "solution", "engine", "software", "system", "infrastructure"]
# End of the fixed values.


TOPIC_PHRASES = {topic: phrases for topics in TOPICS_OF.values() for topic, phrases in topics.items()}
TOPIC_INDUSTRY = {topic: industry for industry, topics in TOPICS_OF.items() for topic in topics}
INDUSTRIES, LOCATIONS, TOPICS = list(INDUSTRY_PHRASES), list(LOCATION_PHRASES), list(TOPIC_PHRASES)


def canonical_names(phrases: dict[str, list[str]]) -> dict[str, str]:
    """Normalised phrase -> canonical name; plurals as written, for field values."""
    return {normalize(p): name for name, ps in phrases.items() for p in [name, *ps]}


def phrase_table(phrases: dict[str, list[str]]) -> dict[tuple[str, ...], str]:
    """Token tuple -> canonical name, for scanning text. A canonical name beats another's alias, then the first one stays."""
    table: dict[tuple[str, ...], str] = {}
    for name, ps in phrases.items():
        for p in [name, *ps]:
            table.setdefault(tuple(tokens(p)), name)
    return table


TOPIC_TABLE = phrase_table(TOPIC_PHRASES)
INDUSTRY_TABLE = phrase_table(INDUSTRY_PHRASES)
LOCATION_TABLE = phrase_table(LOCATION_PHRASES)
INDUSTRY_NAMES = canonical_names(INDUSTRY_PHRASES)
LOCATION_NAMES = canonical_names(LOCATION_PHRASES)


def buckets_overlapping(low: float | None, high: float | None) -> list[str]:
    """Buckets that meet [low, high); a single amount meets the bucket that holds it; an inverted range meets none."""
    lo, hi = low or 0.0, float("inf") if high is None else high
    if lo == hi:
        return [b for b, (b0, b1) in REVENUE_BUCKETS.items() if b0 <= lo < b1]
    return [b for b, (b0, b1) in REVENUE_BUCKETS.items() if lo < hi and b0 < hi and lo < b1]


def noise_phrases(phrases: dict[str, list[str]] = TOPIC_PHRASES) -> list[tuple[str, str]]:
    """Phrases that occur inside a generated opening and so would fire on any description."""
    heads = [tokens(f"{m} {n}") for m in HEAD_MODIFIERS for n in HEAD_NOUNS]
    runs = {tuple(h[i:j]) for h in heads for i in range(len(h)) for j in range(i + 1, len(h) + 1)}
    return [(name, p) for name, ps in phrases.items() for p in ps if tuple(tokens(p)) in runs]
