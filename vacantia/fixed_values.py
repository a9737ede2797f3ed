"""Fixed values.

Everything here must keep exactly these characters, because stored rows, reports and
exports are compared by value: status names, labels, colours, URL patterns, text layouts.
"""

# --- fixed values: statuses and dashboard choices -------------------------------------
STATUSES = ["À postuler", "Postulé", "Refusé", "Entretien"]
DEFAULT_STATUS = "À postuler"
APPLIED_STATUS = "Postulé"
DASHBOARD_SOURCES = ["Adzuna", "Indeed", "APEC"]
DASHBOARD_CONTRACTS = ["CDI", "CDD", "Freelance", "N/A"]
DASHBOARD_MIN_SCORE = 60

# --- fixed values: score classes -------------------------------------------------------
# (lowest score, label), highest class first; the last label takes the rest.
PRIORITY_DASHBOARD = [(85, "★★★ PRIORITAIRE"), (60, "★★ À CONSIDÉRER"), (None, "★ FAIBLE")]
PRIORITY_EXPORT = [(85, "★★★ PRIORITAIRE"), (60, "★★☆ À CONSIDÉRER"), (None, "★☆☆ FAIBLE")]
PRIORITY_REPORT = [(80, "★★★  PRIORITAIRE"), (60, "★★☆  À CONSIDÉRER"), (None, "★☆☆  FAIBLE")]
FILL_EXPORT = [(85, "C6EFCE"), (60, "FFEB9C"), (None, "F2F2F2")]
TEXT_COLOUR = [(85, "color: #1a6b3a"), (60, "color: #7a4f00"), (None, "color: #666666")]
BANDS = [(90, "90-100"), (70, "70-89"), (50, "50-69"), (30, "30-49"), (None, "0-29")]

# --- fixed values: sources -------------------------------------------------------------
# (text looked for in the URL, label), tried in this order.
URL_SOURCES = [("adzuna", "Adzuna"), ("apec", "APEC"), ("indeed", "Indeed")]
SOURCE_RANK = {"adzuna": 0, "apec": 1, "indeed": 2}
APEC_SEARCH_URL = "https://www.apec.fr/candidat/recherche-emploi.html/emploi?motsCles="
APEC_CONTRACTS = "typesConvention=143684&typesConvention=143685&typesConvention=143686&typesConvention=143687"
APEC_OFFER_URL = "https://www.apec.fr/candidat/recherche-emploi.html/emploi/"
PAGE_SIZE_LIMIT = 50
DEFAULT_MAX_RESULTS = 25
DEFAULT_RESULTS_WANTED = 50
DEFAULT_HOURS_OLD = 72
DEFAULT_LOCATION = "France"
DEFAULT_SCORING_LIMIT = 20

# --- fixed values: contract names --------------------------------------------------------
CONTRACT_TIME = {"full_time": "Temps plein", "part_time": "Temps partiel"}
CONTRACT_PERMANENT_FR = "CDI"
CONTRACT_PERMANENT = "Permanent"
CONTRACT_FIXED_TERM = "CDD/Contrat"
NO_CONTRACT = "N/A"

# --- fixed values: salary text -------------------------------------------------------------
SALARY_FROM = "À partir de "
SALARY_BETWEEN = " – "
SALARY_POUNDS = " £/an"
SALARY_EUROS = " €/an"

# --- fixed values: prompt layouts ------------------------------------------------------------
DESCRIPTION_LIMIT = 3000
UNKNOWN_M = "Non précisé"
UNKNOWN_F = "Non précisée"
NO_DESCRIPTION = "Aucune description"
PROMPT_SEPARATOR = "\n\n---\n\n"
PROFILE_TITLE = "## PROFIL CANDIDAT"
PROFILE_JOB = "Poste cible : "
PROFILE_YEARS = ("Expérience : ", " ans")
PROFILE_SKILLS = "Compétences techniques : "
PROFILE_SOFT_SKILLS = "Soft skills : "
PROFILE_CRITERIA = "## CRITÈRES"
PROFILE_CONTRACTS = "Types de contrat acceptés : "
PROFILE_SALARY = ("Salaire minimum : ", " €/an brut")
PROFILE_REMOTE = "Télétravail souhaité : "
PROFILE_PLACES = "Localisation acceptée : "
PROFILE_DEFAULT_PLACE = "Paris / Île-de-France"
PROFILE_SECTORS = "Secteurs préférés : "
PROFILE_COMPANY = "## PRÉFÉRENCES ENTREPRISE"
PROFILE_SIZE = "Taille : "
PROFILE_DEFAULT_SIZE = "Indifférent"
PROFILE_CULTURE = "Culture : "
OFFER_TITLE = "## OFFRE D'EMPLOI"
OFFER_JOB = "Titre : "
OFFER_COMPANY = "Entreprise : "
OFFER_PLACE = "Lieu : "
OFFER_CONTRACT = "Type de contrat : "
OFFER_SALARY = "Salaire : "
OFFER_DESCRIPTION = "### Description de l'offre"
CV_OFFER_TITLE = "## OFFRE D'EMPLOI CIBLE"
CV_CONTRACT = "Contrat : "
CV_DESCRIPTION = "### Description complète"
CV_RULE = "---"
CV_BODY = "## CV HTML À ADAPTER"
CV_REQUEST = "Adapte ce CV HTML pour cette offre en respectant toutes les règles.\nRetourne le HTML complet adapté."

# --- fixed values: report and export layouts ------------------------------------------------
REPORT_WIDTH = 70
REPORT_TITLE = "  RAPPORT DE RECHERCHE D'EMPLOI — "
REPORT_MOMENT = "%d/%m/%Y à %H:%M"
REPORT_COUNT = " offres scorées"
REPORT_END = "  FIN DU RAPPORT"
REPORT_NAME = "offres_%Y%m%d_%H%M.txt"
DOCUMENT_PREFIX = "cv_adapte_"
DOCUMENT_SUFFIX = ".html"
# (line label, column, text when the column is missing or empty)
REPORT_FIELDS = [
    ("  ID         : ", "id", None),
    ("  Poste      : ", "intitule", "N/A"),
    ("  Entreprise : ", "entreprise_nom", "N/A"),
    ("  Lieu       : ", "lieu_travail", "N/A"),
    ("  Contrat    : ", "type_contrat", "N/A"),
    ("  Salaire    : ", "salaire_libelle", "Non précisé"),
    ("  Lien       : ", "url", "N/A"),
]
REPORT_ANALYSIS = "  ANALYSE :"
REPORT_STRONG = ("  POINTS FORTS :", "    + ")
REPORT_WEAK = ("  POINTS FAIBLES :", "    - ")
EXPORT_COLUMNS = [
    "Score", "Priorité", "Poste", "Entreprise", "Lieu", "Contrat", "Salaire", "Source",
    "Analyse", "Points forts", "Points faibles", "URL",
]
SCORING_ERROR = "Erreur : "

# Tasks that ask the model at once, unless a caller says otherwise.
SCORING_TASKS = 8

# Place of sources B and C where the configuration names none.
DEFAULT_PLACE = "France"
