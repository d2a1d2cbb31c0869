"""Rule tables and word lists.

Everything in this module is a *fixed value* that must equal the behaviour
being reproduced (patterns, term lists, weights, label descriptions).  They
are data, kept together in natural order, and feed both the Spark
expressions and the DuckDB oracle text.  Python-regex constructs are
restated for Java regex / RE2 (see ``WS`` and ``WORD``).
"""

from __future__ import annotations

# --- character classes -----------------------------------------------------
# Python's str.split()/\s differ between Java regex and RE2; one explicit
# class is used in every engine.
WS = r"[ \t\n\r\f\x0b]"
WS_CHARS = r" \t\n\r\f\x0b"
# Python's Unicode \w (letters, numbers, underscore).
WORD = r"[\p{L}\p{N}_]"

# --- fixed values: rule clause classifier (C2) -------------------------------
# Category order matters: the first category wins a tie.
CLAUSE_RULES = (
    ("DEFINITION", (r"means\s+.*", r"shall\s+mean\s+.*", r"defined\s+as\s+.*")),
    ("OBLIGATION", (r"shall\s+.*", r"must\s+.*", r"agrees\s+to\s+.*", r"will\s+.*")),
    ("RESTRICTION", (r"shall\s+not\s+.*", r"may\s+not\s+.*", r"cannot\s+.*",
                     r"prohibited\s+from\s+.*")),
    ("TERMINATION", (r"terminat(e|ion)\s+.*", r"end\s+of\s+.*", r"expir(e|ation)\s+.*")),
    ("LIABILITY", (r"liability\s+.*", r"damages\s+.*", r"indemnif(y|ication)\s+.*",
                   r"warrant(y|ies)\s+.*")),
    ("CONFIDENTIALITY", (r"confidential\s+.*", r"secret\s+.*", r"non-disclosure\s+.*",
                         r"proprietary\s+.*")),
)

# --- fixed values: document type keywords (C3) -------------------------------
DOC_TYPE_KEYWORDS = (
    ("legal document", ("contract", "agreement", "legal", "clause", "party", "terms", "conditions")),
    ("article", ("article", "blog", "post", "publication", "journal")),
    ("report", ("report", "analysis", "study", "research", "findings")),
    ("letter", ("dear", "sincerely", "regards", "yours truly")),
    ("memo", ("memorandum", "memo", "to:", "from:", "subject:")),
    ("proposal", ("proposal", "proposed", "suggest", "recommend", "proposition")),
)

# --- fixed values: section type by substring (C1) ----------------------------
SECTION_TYPE_RULES = (
    ("INTRODUCTION", 0.9, ("introduction", "overview", "summary")),
    ("CONCLUSION", 0.9, ("conclusion", "ending", "final")),
    ("MAIN_SECTION", 0.85, ("chapter", "part", "section")),
)
DEFAULT_SECTION_TYPE = ("CONTENT_SECTION", 0.8)

# --- fixed values: gazetteers (E2, E3) ---------------------------------------
STRUCTURE_TERMS = (
    ("Document", "DOCUMENT"), ("File", "FILE"), ("Content", "CONTENT"), ("Text", "TEXT"),
    ("Section", "SECTION"), ("Paragraph", "PARAGRAPH"), ("Title", "TITLE"),
    ("Author", "PERSON"), ("Date", "DATE"), ("Time", "TIME"),
)
FORMAT_TERMS = (
    ("PDF", "FILE_TYPE"), ("DOCX", "FILE_TYPE"), ("Document", "DOCUMENT_TYPE"),
    ("Article", "SECTION_TYPE"), ("Chapter", "SECTION_TYPE"), ("Part", "SECTION_TYPE"),
)
STRUCTURE_CONTEXT = "Document structure"
FORMAT_CONTEXT = "Document format"

# --- fixed values: cue words of the first five sentences (E5) ----------------
INTRO_CUES = ("introduction", "overview", "summary")
CONCLUSION_CUES = ("conclusion", "ending", "final")

# --- fixed values: default entities when nothing is found (E6) ---------------
DEFAULT_ENTITIES = (
    ("Document Content", "CONTENT", 1.0, "Full document"),
    ("Text Content", "TEXT", 1.0, "Document text"),
)

# --- fixed values: legal-term ruler (E4), token sequences, case-insensitive --
LEGAL_TERMS = (
    "agreement", "contract", "clause", "section", "party a", "party b",
    "effective date", "termination date", "warranty", "indemnification",
    "liability", "obligation", "right", "duty", "responsibility",
)

# --- fixed values: NER entity types with descriptions (E9, A2) ---------------
ENTITY_TYPES = (
    ("PARTY", "Contracting parties (e.g., Buyer, Seller, Licensor)"),
    ("OBLIGATION", "Contractual obligations and duties"),
    ("CLAUSE_TYPE", "Types of clauses (e.g., Indemnity, Confidentiality)"),
    ("DATE", "Dates and time periods"),
    ("AMOUNT", "Monetary amounts and financial terms"),
    ("JURISDICTION", "Governing law and jurisdiction"),
    ("TERMINATION", "Termination conditions and clauses"),
)

# --- fixed values: trained-classifier clause types (C6, C8) ------------------
CLAUSE_TYPES = (
    ("INDEMNITY", "Indemnification and liability clauses"),
    ("CONFIDENTIALITY", "Confidentiality and non-disclosure clauses"),
    ("TERMINATION", "Termination and cancellation clauses"),
    ("GOVERNING_LAW", "Governing law and jurisdiction clauses"),
    ("INTELLECTUAL_PROPERTY", "IP rights and ownership clauses"),
    ("WARRANTY", "Warranty and representation clauses"),
    ("LIMITATION_OF_LIABILITY", "Limitation of liability clauses"),
    ("FORCE_MAJEURE", "Force majeure and act of god clauses"),
    ("ASSIGNMENT", "Assignment and transfer clauses"),
    ("AMENDMENT", "Amendment and modification clauses"),
    ("NOTICE", "Notice and communication clauses"),
    ("SEVERABILITY", "Severability and invalidity clauses"),
    ("ENTIRE_AGREEMENT", "Entire agreement and merger clauses"),
    ("WAIVER", "Waiver and non-waiver clauses"),
    ("OTHER", "Other types of clauses"),
)

# --- fixed values: heuristic summary (M1) ------------------------------------
# "conclusion" is listed twice on purpose: a sentence containing it scores
# two hits.
IMPORTANT_TERMS = (
    "introduction", "overview", "summary", "conclusion",
    "important", "key", "main", "primary", "significant",
    "purpose", "objective", "goal", "aim", "target",
    "result", "finding", "conclusion", "recommendation",
    "action", "next step", "follow up", "deadline",
)

# --- fixed values: legal-weight summary (M2) ---------------------------------
LEGAL_WEIGHTS = (
    ("agreement", 2.0), ("contract", 2.0), ("party", 1.5), ("shall", 1.5),
    ("obligation", 1.5), ("right", 1.5), ("duty", 1.5), ("liability", 1.5),
    ("warranty", 1.5), ("indemnification", 1.5), ("termination", 1.5),
    ("confidential", 1.5), ("effective", 1.0), ("date", 1.0), ("term", 1.0),
    ("condition", 1.0),
)

# --- fixed values: section-header predicate (G7), whole stripped line --------
SUMMARY_HEADER_PATTERNS = (
    r"^[A-Z][A-Za-z\s]+:$",
    r"^\d+\.\s+[A-Z][A-Za-z\s]+$",
    r"^[A-Z][A-Za-z\s]+\s+[A-Z][A-Za-z\s]+:$",
)

# --- fixed values: header-delimited sections (G5), match at line start -------
SECTION_HEADER_PATTERNS = (
    r"^(\d+\.\s*[A-Z][^\n]+)",
    r"^([A-Z][A-Z\s]+:)",
    r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*:)",
)

# --- fixed values: date mentions (F1) ----------------------------------------
DATE_PATTERN = (
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"
    r"|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b"
)

# --- fixed values: pattern entities (E1, re-aimed statistical NER) -----------
PATTERN_ENTITY_RULES = (
    ("PARTY", r"\bParty [A-Z]\b"),
    ("PARTY", r"\b[A-Z][A-Za-z0-9#&-]*(?: [A-Z0-9][A-Za-z0-9#&-]*)* (?:Corp|Ltd|Inc)\b"),
    ("DATE", DATE_PATTERN),
    ("AMOUNT", r"\$[\d,]+"),
)

# --- fixed values: key-phrase legal stop words (M5) --------------------------
LEGAL_STOP_WORDS = (
    "hereby", "herein", "hereof", "hereto", "hereunder",
    "thereby", "therein", "thereof", "thereto", "thereunder",
    "whereby", "wherein", "whereof", "whereto", "whereunder",
    "party", "parties", "agreement", "contract", "clause",
    "section", "article", "paragraph", "subparagraph",
)

# --- fixed values: English stop words ----------------------------------------
# Frozen copy of Spark ML's default English list
# (StopWordsRemover.loadDefaultStopWords("english")), so that the Spark side
# and the SQL oracle use one list.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your",
    "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her",
    "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with",
    "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where",
    "why", "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "s", "t", "can", "will", "just", "don", "should", "now", "i'll",
    "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd",
    "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't",
    "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't",
    "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't",
    "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's",
    "what's", "when's", "where's", "who's", "why's", "would",
)

# --- fixed values: admission (S3), summary texts (M8), warnings (A1) ---------
MAX_FILE_BYTES = 10 * 1024 * 1024
ALLOWED_SUFFIXES = ("pdf", "docx")
MIN_WORDS = 10

EMPTY_SUMMARY = "No text content available for summary generation."
EMPTY_FALLBACK = "The document appears to be empty or contains no readable text."
NO_SENTENCE_SUMMARY = "Document contains no valid sentences for summary generation."
NO_SENTENCE_FALLBACK = "The document appears to contain no valid sentences."

WARN_ENTITIES = "Limited entity detection - document may not contain clear legal terms"
WARN_SECTIONS = "Limited clause detection - document may not be in standard legal format"
WARN_SUMMARY = "Summary is brief - document may be too short or complex for detailed summary"

# Core metadata keys hidden from the "additional metadata" view.
CORE_METADATA_KEYS = ("filename", "file_type", "file_size", "title", "author", "creation_date")
