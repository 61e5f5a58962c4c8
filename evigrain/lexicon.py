"""Word lists, expansions and patterns that decide which text matches; order matters."""

# Words of a question or field that tell nothing.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "patients",
    "relationship", "study", "the", "to", "using", "what", "with",
]
GENERIC_WORDS = ["analysis", "criteria", "level", "levels", "model", "score", "scores", "test", "use", "value", "values", "variable", "variables"]

# What a word of a question also asks for.
EXPANSIONS = {
    "mortality": ["mortality", "death", "died", "deceased", "fatality", "survival"],
    "death": ["mortality", "death", "died", "deceased", "fatality", "survival"],
    "lactate": ["lactate", "lactic"],
    "sofa": ["sofa", "sequential organ failure assessment"],
    "apache": ["apache", "acute physiology"],
    "auc": ["auc", "auroc", "area under", "roc"],
    "auroc": ["auc", "auroc", "area under", "roc"],
    "or": ["odds ratio", "or"],
    "hr": ["hazard ratio", "hr"],
    "risk": ["risk", "odds ratio", "hazard ratio", "regression"],
    "counterfactual": ["control", "untreated", "expected mortality", "risk", "prognostic"],
    "sepsis": ["sepsis", "septic", "infection", "shock"],
}
DEFAULT_TERMS = ["sepsis", "mortality", "auc", "odds ratio", "lactate", "sofa"]
BONUSES = {"mortality": 2.0, "death": 1.5, "auc": 2.0, "auroc": 2.0, "odds ratio": 1.5, "hazard ratio": 1.5, "regression": 1.0, "sepsis": 1.0, "septic": 1.0}
ANCHOR_TERMS = ["mortality", "death", "auc", "auroc", "odds ratio", "hazard ratio", "regression"]
DEFAULT_QUESTION = "What is the relationship between lactate level and 28-day mortality in septic shock?"

# Patterns of the other fields.
POPULATION_WORDS = ["patients", "cohort", "included", "enrolled", "admitted"]
SAMPLE_PATTERNS = [
    r"\bN\s*=\s*[\d,]+",
    r"\bn\s*=\s*[\d,]+",
    r"\btotal of [\d,]+ (?:eligible )?(?:patients|subjects|encounters)\b",
    r"\b[\d,]+ (?:eligible )?(?:patients|subjects|encounters) (?:were )?(?:included|enrolled|admitted)\b",
    r"\b[\d,]+ (?:patients|subjects|encounters)\b",
]
DEATH_PATTERNS = [
    r"\b(?:died|deaths?|non-survivors?)\s*(?:n\s*)?=?\s*[\d,]+",
    r"\b[\d,]+\s*(?:patients )?(?:died|deaths?|non-survivors?)\b",
    r"\bmortality (?:rate )?(?:was|of)?\s*[\d.]+%",
]
PREDICTORS = [
    ("Lactate", r"\b(?:lactate|lactic acid)\b"),
    ("SOFA score", r"\bSOFA\b|sequential organ failure assessment"),
    ("qSOFA score", r"\bqSOFA\b"),
    ("APACHE score", r"\bAPACHE(?:\s+II|\s+III)?\b"),
    ("SIRS criteria", r"\bSIRS\b"),
    ("Lymphocyte count", r"\blymphocyte"),
    ("Neutrophil-to-lymphocyte ratio", r"\bNLR\b|neutrophil[- ]to[- ]lymphocyte"),
    ("IL-6", r"\bIL[- ]?6\b|interleukin[- ]?6"),
    ("Presepsin", r"\bpresepsin\b"),
    ("Procalcitonin", r"\bPCT\b|procalcitonin"),
    ("C-reactive protein", r"\bCRP\b|C-reactive protein"),
    ("Bilirubin", r"\bbilirubin\b"),
    ("Phosphate", r"\bphosphate|hypophosphat"),
    ("Hematocrit", r"\bhematocrit\b"),
    ("Mean corpuscular volume", r"\bMCV\b|mean corpuscular volume"),
    ("Age", r"\bage\b"),
    ("Charlson Comorbidity Index", r"\bCharlson\b|\bCCI\b"),
    ("Glasgow Coma Scale", r"\bGCS\b|Glasgow Coma"),
    ("Temperature", r"\btemperature\b"),
    ("Oxygenation index", r"\boxygenation index\b"),
    ("Albumin", r"\balbumin\b"),
    ("BUN", r"\bBUN\b|blood urea nitrogen"),
    ("Creatinine", r"\bcreatinine\b"),
    ("Platelet count", r"\bplatelet"),
    ("Vasopressor use", r"\bvasopressor"),
    ("Mechanical ventilation", r"\bmechanical ventilation\b|\bMV\b"),
    ("Renal replacement therapy", r"\brenal replacement therapy\b|\bRRT\b|\bCRRT\b"),
]
METHODS = [
    ("ROC analysis", r"\bROC\b|receiver operating characteristic|AUROC|AUC"),
    ("Logistic regression", r"logistic regression"),
    ("Cox regression", r"\bCox\b|hazard ratio"),
    ("Multivariable regression", r"multivariable|multivariate"),
    ("LASSO regression", r"\bLASSO\b"),
    ("Kaplan-Meier analysis", r"Kaplan[- ]Meier"),
    ("Random forest", r"random forest"),
    ("Machine learning model", r"machine learning|XGBoost|gradient boosting|neural network"),
]
OUTCOME_PATTERNS = [
    r"\b(?:28|30|60|90|180|365)[- ]day (?:all[- ]cause )?(?:mortality|death)\b",
    r"\b(?:in[- ]hospital|hospital|ICU|one[- ]year|1[- ]year) (?:mortality|death)\b",
    r"\bmortality (?:within|at) (?:28|30|60|90|180|365) days\b",
    r"\bsurvival\b",
]
OUTCOME_SENTENCE = r"\bmortality|death|survival\b"
TIMING_PATTERNS = [
    r"\bwithin (?:the )?first \d+\s*(?:h|hr|hour|hours|day|days)\b",
    r"\bfirst \d+\s*(?:h|hr|hour|hours|day|days)\b",
    r"\b(?:on|at) (?:ICU |hospital |ED )?admission\b",
    r"\bat (?:the time of )?(?:sepsis )?diagnosis\b",
    r"\bbaseline\b",
    r"\bday [0-9]+\b",
]
# Patterns of effects and of performance.
EFFECT_PATTERNS = [
    r"\b(?:OR|odds ratio)\s*(?:=|of|:)?\s*[0-9]+(?:\.[0-9]+)?(?:\s*\([^)]+\))?(?:\s*,?\s*p\s*[<=>]\s*0?\.[0-9]+)?",
    r"\b(?:HR|hazard ratio)\s*(?:=|of|:)?\s*[0-9]+(?:\.[0-9]+)?(?:\s*\([^)]+\))?(?:\s*,?\s*p\s*[<=>]\s*0?\.[0-9]+)?",
    r"\b(?:RR|relative risk|risk ratio)\s*(?:=|of|:)?\s*[0-9]+(?:\.[0-9]+)?(?:\s*\([^)]+\))?",
    r"\bcut[- ]?off(?: value)?\s*(?:=|of|:)?\s*[<>]?\s*[0-9]+(?:\.[0-9]+)?(?:\s*[x×]\s*10\^?[0-9]+)?",
]
PERFORMANCE_PATTERNS = [
    r"\b(?:AUC|AUROC)\s*(?:=|of|:)?\s*0?\.[0-9]{2,3}(?:\s*\([^)]+\))?",
    r"\barea under (?:the )?(?:ROC |receiver operating characteristic )?curve\s*(?:=|of|:)?\s*0?\.[0-9]{2,3}(?:\s*\([^)]+\))?",
    r"\bsens(?:itivity)?\s*(?:=|:)?\s*[0-9]+(?:\.[0-9]+)?%?",
    r"\bspec(?:ificity)?\s*(?:=|:)?\s*[0-9]+(?:\.[0-9]+)?%?",
]
FALLBACK_NOTE = "Regex fallback extraction; review source anchor before clinical use."
# What a CSV reader takes for an absent value.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
