"""Defaults and fixed value lists used by the analyses.

Everything here is plain data; every operator takes the value as an argument and only falls back to
these defaults.
"""

from __future__ import annotations


# --- thresholds and sizes (fixed values) -------------------------------------------------------------
START_DATE = "2000-01-01"
END_DATE = "today"
INTERVALS_IN_A_YEAR = 1
TOPIC_LEVELS = (1,)
TOPIC_PERCENTILES = (75,)
GENDER_PROBABILITY = 0.7
METRIC_YEAR = "2013"
MIN_PAPERS = 10
MIN_TOPICS = 10
COLLABORATION_YEAR = "2013"
INDICATOR_START_YEAR = "2013"
INDICATOR_END_YEAR = "2019"
RCA_CAP = 6.0
NEIGHBOURS = 5
SIMILARITY_MIN_PAPERS = 2
SHORT_ABSTRACT = 300
PAPER_YEAR = "2012"
SVD_COMPONENTS = 500
SVD_PASSES = 4
SVD_OVERSAMPLE = 10
PROJECTION_DIMS = 3
NAME_BATCH_SIZE = 10_000
ENCODER_BATCH_SIZE = 1_000
CLOSURE_HOPS = 5

# Place-service country name -> development-indicator country name (fixed values).  Three names have no
# counterpart and map to null.
PLACE_TO_INDICATOR_COUNTRY = {
    "Brunei": "Brunei Darussalam",
    "Cape Verde": "Cabo Verde",
    "Czechia": "Czech Republic",
    "Côte d'Ivoire": "Cote d'Ivoire",
    "Democratic Republic of the Congo": "Congo, Dem. Rep.",
    "Egypt": "Egypt, Arab Rep.",
    "Hong Kong": "Hong Kong SAR, China",
    "Iran": "Iran, Islamic Rep.",
    "Laos": "Lao PDR",
    "Macao": "Macao SAR, China",
    "PS": None,
    "Russia": "Russian Federation",
    "Réunion": None,
    "Saint Kitts and Nevis": "St. Kitts and Nevis",
    "Slovakia": "Slovak Republic",
    "South Korea": "Korea, Rep.",
    "Taiwan": None,
    "Venezuela": "Venezuela, RB",
    "North Korea": "Korea, Dem. People’s Rep.",
    "Myanmar (Burma)": "Myanmar",
}

# Place-service country name -> country-details name (fixed values), tried when the name itself fails.
PLACE_TO_DETAILS_COUNTRY = {
    "United States": "United States of America",
    "North Macedonia": "Macedonia",
    "South Korea": "Korea (Republic of)",
    "Democratic Republic of the Congo": "Congo (Democratic Republic of the)",
    "Cape Verde": "Cabo Verde",
    "Czechia": "Czech Republic",
    "North Korea": "Korea (Democratic People's Republic of)",
    "Myanmar (Burma)": "Myanmar",
}

# Countries whose details are the second element of the response (fixed values).
SECOND_MATCH_COUNTRIES = ("India", "United States", "Sudan")

# Tokens marking an affiliation as non-industry (fixed values).
NON_INDUSTRY_TOKENS = (
    "park centre for mental health",
    "university",
    "foundation",
    "institution",
    "universidade",
    "institute",
    "commission",
    "agency",
    "department",
    "council",
    "college",
    "ministry",
    "universidad",
    "school",
    "international centre",
    "universiti",
    "hospital",
    "medical center",
    "united states fish and wildlife service",
    "centre",
    "center",
    "laboratory",
    "universiteti",
    "kantonsspital st gallen",
    "infirmary",
    "centro",
    "museum",
    "academy",
    "istituto",
    "national association",
    "conservation trust",
    "instituto",
    "ezemvelo kzn wildlife",
    "nhs trust",
    "universite",
    "society",
    "united states office of research integrity",
    "missouri botanical garden",
    "nhs lothian",
    "zurcher fachhochschule",
    "administration",
    "ecole",
    "congressional research service",
    "universitat",
    "bureau",
    "clinical trial service unit",
    "fachhochschule lubeck",
    "umass memorial health care",
    "penn state abington",
    "federation",
    "office of",
    "nhs greater glasgow and clyde",
    "intelligence and national security alliance",
    "rambam health care campus",
    "cancer research uk",
    "carolinas healthcare system",
    "arthritis research uk",
    "vancouver coastal health",
    "red cross",
    "commonwealth scientific and industrial",
    "institut",
    "academia",
    "association",
    "fondazione",
    "faculty",
    "escuela",
    "facultad de filosofia y letras",
    "coral reef alliance",
    "fundacion",
    "queensland health",
    "jamia millia islamia",
    "polytechnic",
    "united states forest service",
    "national ecological observatory network",
    "national guard health affairs",
    "geoscience australia",
    "statistics canada",
    "health service executive",
    "district",
    "national marrow donor program",
    "junta of andalusia",
    "american board of legal medicine",
    "geological survey of denmark and greenland",
    "australia bioinformatics resource",
    "south african weather service",
    "scottish national blood transfusion service",
    "pancreatic cancer action network",
    "va palo alto healthcare system",
    "swiss federal laboratories for materials",
    "defence research and development organisation",
    "conservation international",
    "european union",
    "clalit health services",
    "comision nacional",
    "departamento",
    "office national",
    "rajiv gandhi proudyogiki vishwavidyalaya",
    "nhs blood and transplant",
    "european molecular biology organization",
    "facultad",
    "united nations environment programme",
    "national health service",
    "rochester general health system",
    "bundesanstalt fur materialforschung und prufung",
    "drugs for neglected diseases initiative",
    "gundersen health system",
    "fisheries and oceans canada",
    "food safety and inspection service",
    "civil aviation authority of singapore",
    "union of concerned scientists",
    "california state water resources control board",
    "wright patterson air force base",
    "bioversity international",
    "marine scotland",
    "qatar national library",
    "american geophysical union",
    "cherokee nation",
    "national radio astronomy observatory",
    "asia pacific economic cooperation",
    "the leprosy mission international",
    "kenya wildlife service",
    "australian taxation office",
    "breast cancer now",
    "pan american health organization",
    "united states public health service",
    "butterfly conservation",
    "king abdulaziz medical city",
)

# Open-access journals (fixed values).
OPEN_ACCESS_JOURNALS = (
    "arxiv computation and language",
    "arxiv adaptation and self organizing systems",
    "arxiv artificial intelligence",
    "arxiv multiagent systems",
    "arxiv computational engineering finance and science",
    "arxiv neurons and cognition",
    "arxiv learning",
    "arxiv data analysis statistics and probability",
    "arxiv quantitative methods",
    "biorxiv",
    "arxiv computer vision and pattern recognition",
    "arxiv information theory",
    "arxiv signal processing",
    "arxiv sound",
    "arxiv image and video processing",
    "arxiv social and information networks",
    "arxiv materials science",
    "arxiv neural and evolutionary computing",
    "arxiv statistical mechanics",
    "arxiv networking and internet architecture",
    "arxiv machine learning",
    "arxiv high energy physics phenomenology",
    "arxiv software engineering",
    "arxiv molecular networks",
    "arxiv physics and society",
    "arxiv quantum physics",
    "arxiv applications",
    "arxiv cryptography and security",
    "arxiv robotics",
    "arxiv instrumentation and methods for astrophysics",
    "arxiv distributed parallel and cluster computing",
    "arxiv computational geometry",
    "arxiv statistical finance",
    "arxiv computers and society",
    "arxiv human computer interaction",
    "chemrxiv",
    "arxiv high energy astrophysical phenomena",
    "arxiv econometrics",
    "arxiv optimization and control",
    "arxiv computational physics",
    "arxiv atmospheric and oceanic physics",
    "arxiv genomics",
    "arxiv trading and market microstructure",
    "medrxiv",
    "arxiv disordered systems and neural networks",
    "arxiv computer science and game theory",
    "arxiv biomolecules",
    "arxiv strongly correlated electrons",
    "arxiv audio and speech processing",
    "arxiv cosmology and nongalactic astrophysics",
    "arxiv methodology",
    "arxiv multimedia",
    "arxiv data structures and algorithms",
    "arxiv databases",
    "arxiv digital libraries",
    "arxiv optics",
    "arxiv programming languages",
    "arxiv numerical analysis",
    "arxiv chemical physics",
    "arxiv fluid dynamics",
    "arxiv other computer science",
    "arxiv emerging technologies",
    "arxiv statistics theory",
    "arxiv medical physics",
    "arxiv other statistics",
    "arxiv logic in computer science",
    "arxiv information retrieval",
    "arxiv probability",
    "arxiv applied physics",
    "socarxiv",
    "arxiv mesoscale and nanoscale physics",
    "arxiv computational finance",
    "arxiv geophysics",
    "arxiv dynamical systems",
    "arxiv high energy physics lattice",
    "arxiv physics education",
    "arxiv astrophysics of galaxies",
    "arxiv risk management",
    "arxiv biological physics",
    "arxiv soft condensed matter",
    "arxiv solar and stellar astrophysics",
    "arxiv portfolio management",
    "arxiv instrumentation and detectors",
    "arxiv theoretical economics",
    "arxiv general economics",
    "arxiv high energy physics theory",
    "arxiv graphics",
    "arxiv populations and evolution",
    "arxiv general relativity and quantum cosmology",
    "arxiv mathematical finance",
    "arxiv earth and planetary astrophysics",
    "arxiv atomic and molecular clusters",
    "arxiv algebraic topology",
    "arxiv pattern formation and solitons",
    "arxiv general literature",
    "arxiv performance",
    "arxiv tissues and organs",
    "arxiv analysis of pdes",
    "arxiv general finance",
    "arxiv quantum gases",
    "arxiv superconductivity",
    "arxiv hardware architecture",
    "arxiv space physics",
    "arxiv pricing of securities",
    "arxiv mathematical software",
    "arxiv computation",
    "arxiv nuclear theory",
    "arxiv plasma physics",
    "arxiv combinatorics",
    "arxiv astrophysics",
    "arxiv cell behavior",
    "arxiv formal languages and automata theory",
    "arxiv computational complexity",
    "arxiv systems and control",
    "arxiv chaotic dynamics",
    "arxiv algebraic geometry",
    "arxiv category theory",
    "arxiv popular physics",
    "arxiv symbolic computation",
    "arxiv discrete mathematics",
    "arxiv accelerator physics",
    "arxiv other quantitative biology",
    "arxiv general physics",
    "arxiv classical analysis and odes",
    "arxiv high energy physics experiment",
    "arxiv economics",
    "arxiv group theory",
    "arxiv history and overview",
    "arxiv logic",
    "arxiv general topology",
    "arxiv functional analysis",
    "psyarxiv",
    "arxiv operating systems",
    "arxiv nuclear experiment",
    "arxiv number theory",
)

# Names of authors (fixed values): symbols that are no part of a name, and initials inside a word.
NAME_SYMBOLS = r'[)(#"!:]|-{2,}'
NAME_INITIALS = (r"(?d).?\.", r"(?U)[A-Z]*-[A-Z]\b")
