"""Word lists, thresholds and patterns that results depend on.

Everything here is data, listed plainly because query results must agree with it.
"""

from __future__ import annotations

# --- token patterns -----------------------------------------------------------
SEARCH_TOKEN = r"[A-Za-z][A-Za-z0-9_\-\.]+"
WORD_TOKEN = r"[A-Za-z0-9_\-\.]+"
EXTRACTION_TOKEN = r"[a-z0-9]+"
TOPIC_TOKEN = r"[a-zA-Z][a-zA-Z0-9_\-]*[a-zA-Z0-9]|[a-zA-Z]{3,}"
YEAR = r"(?U)\b(?:19|20)\d{2}\b"
# Unicode white space plus the four separator controls; meant for patterns under (?U).
SPACE = r"[\s\x1C-\x1F]"
NON_SPACE = r"[^\s\x1C-\x1F]"
SPACES = "(?U)" + SPACE + "+"
NON_SPACES = "(?U)" + NON_SPACE + "+"

# --- word lists ---------------------------------------------------------------
QUERY_STOPWORDS = "the a an of and for to in on at by with".split()

METADATA_TERMS = "isbn publisher published publication year author authors title edition".split()
OVERVIEW_TERMS = ("topics topic chapters chapter contents outline covered covers about overview "
                  "sections table").split()
NUMERIC_TERMS = ("calculate compute equation formula derive proof odds probability logit coef "
                 "coefficient regression value estimate fit").split()
NUMERIC_TRIGGERS = "calculate compute derive equation formula".split()
FACT_OPENERS = "who when where which whom".split()
INFORMATIONAL_OPENERS = "tell explain describe show give find list".split()
NEWS_TERMS = ("news politics political election elections happening championship tournament league "
              "playoffs semifinal final olympics superbowl winner champion champions scored "
              "standings").split()
RECENCY_TERMS = "today yesterday tonight currently nowadays last latest recent now".split()
STRONG_RECENCY_TERMS = "today yesterday tonight currently nowadays now".split()
# The web fallback's own, narrower lists (fixed values).
WEB_NEWS_TERMS = ("news", "politics", "political", "election", "elections", "happening")
WEB_RECENCY_TERMS = ("today", "yesterday", "tonight", "currently", "nowadays")
RELEASE_VERBS = "released release launched launch unveiled unveil announced announce".split()

ANSWER_STOPWORDS = ("the a an of and for to in on at by with is are was were be does do what who "
                    "when where why how").split()
COVERAGE_STOPWORDS = (
    "book chapter section page text document say says tell tells explain explains describe "
    "describes discuss discusses according states about cover covers mention mentions define "
    "defines mean means meaning overview basics explanation detail details summary main key "
    "primary overall goal take advantage full management can you get please help show find need "
    "want know give information more could would").split()
ENTITY_IGNORE = (
    "the this that these those and but for with from into low high answer citations model models "
    "method methods approach approaches chapter section figure table note notes introduction "
    "conclusion summary overview example definition theorem proof result results algorithm "
    "function equation formula matrix machine learning neural network networks deep data training "
    "test loss gradient weight weights investment fund funds market return returns risk asset "
    "assets portfolio equity really").split()

FACTOID_HINTS = ("isbn publisher published publication year author authors title chapter section "
                 "where when who define definition meaning").split()
METADATA_FACT_HINTS = "isbn publisher published publication author authors title".split()
COVERAGE_FACT_OPENERS = "what who when where which whom".split()
FACTOID_OPENERS = "what who when where which".split()

TOPIC_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may "
    "might shall can need must and or but if in on at to for of with by from up about into through "
    "during this that these those it its we you they he she i my your their our which who what how "
    "when where why not no so as than then each all any both few more most other some such only own "
    "same also very just s t figure table chapter section page appendix however therefore thus hence "
    "since while let note see use using used given well one two three first second new different "
    "important many often between there over because like before less across known called them take "
    "down work build shown follows based form true number case line order small large high step "
    "output input approach consider discuss example examples book course document present strong "
    "early instead multiple better forward increases decreases research").split()

# --- structural roles ---------------------------------------------------------
ROLE_METADATA_CONTENT = ("isbn", "copyright", "all rights reserved", "first published",
                         "library of congress", "cataloging-in-publication",
                         "printed in the united states")
ROLE_METADATA_TITLE = ("copyright", "credits")
ROLE_FRONTMATTER_TITLE = ("preface", "foreword", "abstract", "acknowledgment", "acknowledgments",
                          "acknowledgements", "table of contents", "contents", "introduction",
                          "about the author", "about the authors")
ROLE_INDEX_TITLE = ("index", "bibliography", "references", "further reading", "glossary", "appendix")
BIBLIOGRAPHY_TITLE = r"(?i)bibliograph|reference[s]?\s*$|works\s+cited|further\s+reading"

# --- evidence and source kinds ------------------------------------------------
APPENDIX_PHRASES = ("appendix", "table of contents", "revision history", "good faith efforts",
                    "gfe outreach")
REFERENCE_PHRASES = ("refer to", "see appendix", "see form", "refer to dmi", "refer to gmi")

# (kind, phrases any of which suffices, and phrase groups all of which must be present)
SOURCE_KIND_RULES = (
    ("rfq",
     ("rfq no.", "request for qualification", "request for qualifications",
      "city of tampa, florida - rfq", "selection & certification committee",
      "transmittal memorandum"), ()),
    ("scada_standard", (),
     (("scada standards volume", "scada & pcs standards", "city standards", "standard details",
       "display definitions", "changeset files", "graphic symbols", "historian exchange"),
      ("hmi", "oit", "scada", "pcs", "plc", "historian", "programming software"))),
    ("workshop_note",
     ("meeting minutes", "workshop no.", "discussion items:", "attendees:", "meeting agenda",
      "action items"), ()),
    ("evaluation_memo",
     ("evaluation", "report creator software", "hardware evaluation", "software platform",
      "ranking of", "scoring", "recommended platform", "comparison matrix"),
     (("ignition", "xlreport", "pivision", "factorytalk", "vtscada"),
      ("evaluation", "ranking", "score", "comparison", "option"))),
    ("appendix_form",
     ("good faith effort", "gfecp", "solicited subcontractors", "to-be-utilized sub-",
      "respondent certification", "non-collusion affidavit", "signature of respondent",
      "notary public", "sworn to and subscribed", "bid form", "proposal form"),
     (("appendix", "form", "affidavit", "certification"),
      ("signature", "respondent", "subcontractor", "notary", "acknowledged before me"))),
    ("background_reference",
     ("1.1 background", "master plan", "is permitted to treat", "type i two-stage", "tampa bay",
      "historically", "existing facility"), ()),
)
SOURCE_KIND_LABELS = {
    "rfq": "RFQ", "scada_standard": "SCADA Standard", "workshop_note": "Workshop Note",
    "evaluation_memo": "Evaluation Memo", "appendix_form": "Appendix/Form",
    "background_reference": "Background Reference", "unknown": "Other Source",
}

# --- scoring ------------------------------------------------------------------
SOURCE_AUTHORITY = {"pdf_book": 1.00, "pdf_paper": 0.95, "pdf_report": 0.92, "docx": 0.90,
                    "notes": 0.70, "web": 0.72, "internet": 0.60, "general": 0.50}
INTENT_ALPHAS = {
    "metadata_lookup": (0.58, 0.42), "formula_lookup": (0.72, 0.28), "section_lookup": (0.65, 0.24),
    "comparison": (0.65, 0.24), "list_lookup": (0.65, 0.24), "summary": (0.62, 0.24),
    "fact_lookup": (0.68, 0.24), "exploratory": (0.62, 0.24), "current_data_lookup": (0.68, 0.32),
    "implicit_followup": (0.68, 0.32),
}
DIVERSIFY_INTENTS = ("summary", "comparison", "list_lookup", "exploratory")
RERANK = dict(alpha_vector=0.68, alpha_lexical=0.24, keyword_per_match=0.05, keyword_cap=0.25,
              header_per_match=0.06, header_cap=0.24, phrase_bonus=0.14, stub_penalty=0.15,
              diversity_penalty=0.10, table_bonus=0.03, short_bonus=0.02, short_below=250,
              stub_below=20)
CROSS_SCORER = dict(weight=0.25, top_n=24)
RRF_K = 60
CONFIDENCE = dict(medium=0.55, high=0.70, borderline=0.62, ambiguous_gap=0.03)
COVERAGE_GATES = dict(min_score=0.38, min_lexical=0.55, entity_support=0.40)
CITATIONS = dict(window=0.06, minimum=2, maximum=3)
BM25 = dict(k1=1.5, b=0.75, epsilon=0.25)

# --- chunking -----------------------------------------------------------------
CHUNKING = dict(max_tokens=400, min_tokens=40, merge_max_tokens=520, max_chars=4000,
                overlap_chars=200, chars_per_page=3500, min_page_chars=2000)

# --- text repair --------------------------------------------------------------
BULLETS = ("•", "◦", "▪", "►", "▶", "‣", "●", "○", "�")
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta",
    "θ": "theta", "λ": "lambda", "μ": "mu", "π": "pi", "σ": "sigma", "τ": "tau", "φ": "phi",
    "χ": "chi", "ψ": "psi", "ω": "omega", "Σ": "Sigma", "Π": "Pi", "Δ": "Delta", "Θ": "Theta",
    "Λ": "Lambda",
}

# --- web results --------------------------------------------------------------
BIOGRAPHICAL_TERMS = (
    "son daughter wife husband father mother brother sister spouse partner child children youngest "
    "oldest eldest parent sibling born died age birthday birthplace nationality married divorced "
    "family").split()
LOW_VALUE_DOMAINS = (
    "merriam-webster.com", "dictionary.com", "dictionary.cambridge.org", "vocabulary.com",
    "thesaurus.com", "collinsdictionary.com", "thefreedictionary.com", "macmillandictionary.com",
    "lexico.com")
LOW_VALUE_PATHS = ("/dictionary", "/define", "/meaning", "/thesaurus")
PREFERRED_DOMAINS = (
    "openai.com", "wikipedia.org", "britannica.com", "techcrunch.com", "time.com", "mashable.com",
    "arstechnica.com", "ibm.com", "mindstudio.ai", "fifa.com", "sportingnews.com", "apnews.com",
    "reuters.com")
DEMOTED_DOMAINS = ("github.com", "chat4us")
# Words of a web question that say nothing of its subject.
WEB_QUERY_STOPWORDS = (
    "the", "a", "an", "of", "and", "for", "to", "in", "on", "at", "by", "with", "is", "are", "was", "were", "be",
    "been", "what", "who", "when", "where", "which", "whom", "current", "did", "does", "do", "it", "this", "that",
    "as", "how", "tell", "explain", "describe", "show", "give", "find", "list", "about", "me", "us")
WEB = dict(vector_weight=0.72, min_relevance=0.42, strong_local=0.62, cap_below_local=0.02,
           window=900, overlap=160, sentence_cut_after=320, max_non_ascii=0.12, max_cjk=0.15)

# --- conversations ------------------------------------------------------------
NOT_ENTITY = (
    "The This That These Those When Where What Which While With From Into About More Some Also Then "
    "Than Just Even Other Like Well Based Given According However Therefore Thus Since After Before "
    "During Between Through Around Under Over Against Within Without Both Either Yes No Not But And "
    "Or Nor So Yet For At By On In Of To Its Has Have Had Was Were Are Is Be He She They We You I "
    "It").split()
ENTITY_PHRASE = r"(?U)\b([A-Z][A-Za-z]{1,}(?:\s+[A-Z][A-Za-z]{1,})*)\b"

# --- mathematical notation ----------------------------------------------------
MATH_PATTERNS = (
    r"[A-Za-zΑ-Ωα-ω]\s*=\s*[\d\(\[A-Za-zΑ-Ωα-ω]",
    r"[αβγδεζηθμσρλπΣΠΔΩ]",
    r"\b\d+\s*[\+\-×÷\*\/]\s*\d+",
    r"\bE\s*\[|\bVar\s*\(|\bCov\s*\(",
    r"r_[ipm]\b|\br_f\b|\bbeta\b",
    r"\bsqrt\b|\bln\b|\blog\b|\bexp\b",
)

# --- run progress: (kind of test, text, phase, stage, percent) -----------------
PROGRESS_RULES = (
    (("starts:starting extraction project",), "running", "initializing", 2),
    (("starts:collection:",), "running", "collection_ready", 4),
    (("has:ingesting",), "ingestion", "ingesting", 8),
    (("starts:building corpus index",), "running", "building_corpus", 18),
    (("starts:warming llm",), "running", "warming_llm", 24),
    (("starts:branch ",), "running", "branch_start", 30),
    (("has:retrieving chunks",), "running", "retrieval", 36),
    (("has:scan batch",), "running", "scan", 46),
    (("has:synthesis",), "running", "synthesis", 60),
    (("both:saved|checkpoint",), "running", "checkpointing", 68),
    (("has:second pass",), "post", "second_pass", 78),
    (("has:building report",), "report", "building_report", 88),
    (("has:report saved to:",), "report", "report_saved", 96),
    (("has:extraction complete", "has:report-only rerun complete"), "done", "completed", 100),
    (("starts:error",), "error", "error", None),
)
