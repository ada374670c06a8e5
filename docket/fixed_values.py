"""Fixed values.

Everything in this file is a constant that has to equal the established value for results to be right: word lists,
patterns, thresholds, labels. They are stated plainly, in their natural order, and nothing else in the package
repeats them.
"""

# --- sections, in report order -------------------------------------------------------------------------------------

SECTIONS = [
    ("RELIANCE_LETTER", "Reliance Letter"),
    ("EO_INSURANCE", "E&O Insurance"),
    ("COVER_WRITEUP", "Cover / Write-Up"),
    ("APPENDIX_A", "APPENDIX A - Property Location Map & Plot Plan"),
    ("APPENDIX_B", "APPENDIX B - Property & Vicinity Photographs"),
    ("APPENDIX_C", "APPENDIX C - Database Report"),
    ("APPENDIX_D", "APPENDIX D - Historical Records Research"),
    ("APPENDIX_E", "APPENDIX E - Public Agency Records / Other Documents"),
    ("REPORTS_AFTER_E", "Supporting Reports (after Appendix E)"),
    ("APPENDIX_F", "APPENDIX F - Qualifications of Environmental Professional"),
]
UNCLASSIFIED = ("UNCLASSIFIED", "Unclassified Documents")

# Order of the sub-groups of Appendix D; anything else sorts at OTHER_POSITION.
SUBCATEGORIES = ["sanborn", "aerials", "topos", "city_directory"]
OTHER_POSITION = 99

# Source groups of supporting reports: (text looked for in name or path, position).
SOURCE_GROUPS = [("bla-", 0), ("ec_attachments", 1), ("smeh", 2), ("geotracker", 3)]

# section, min pages, max pages, min docs, max docs
SECTION_RANGES = [
    ("EO_INSURANCE", 1, 3, 1, 1),
    ("COVER_WRITEUP", 20, 80, 1, 3),
    ("APPENDIX_A", 1, 10, 1, 5),
    ("APPENDIX_B", 2, 100, 1, 80),
    ("APPENDIX_C", 100, 1500, 1, 3),
    ("APPENDIX_D", 30, 300, 3, 20),
    ("APPENDIX_E", 20, 300, 3, 30),
    ("REPORTS_AFTER_E", 0, 500, 0, 15),
    ("APPENDIX_F", 2, 10, 1, 2),
]

# Sections a report is expected to fill, with the label used in pre-flight messages.
EXPECTED_SECTIONS = [
    ("APPENDIX_A", "Appendix A — Maps & Plot Plan"),
    ("APPENDIX_B", "Appendix B — Site Photographs"),
    ("APPENDIX_C", "Appendix C — Database Report"),
    ("APPENDIX_D", "Appendix D — Historical Records"),
]

SECTION_ALIASES = [
    ("reliance", "RELIANCE_LETTER"),
    ("reliance letter", "RELIANCE_LETTER"),
    ("e&o", "EO_INSURANCE"),
    ("eo", "EO_INSURANCE"),
    ("insurance", "EO_INSURANCE"),
    ("cover", "COVER_WRITEUP"),
    ("writeup", "COVER_WRITEUP"),
    ("write-up", "COVER_WRITEUP"),
    ("write up", "COVER_WRITEUP"),
    ("appendix a", "APPENDIX_A"),
    ("app a", "APPENDIX_A"),
    ("maps", "APPENDIX_A"),
    ("appendix b", "APPENDIX_B"),
    ("app b", "APPENDIX_B"),
    ("photos", "APPENDIX_B"),
    ("photographs", "APPENDIX_B"),
    ("appendix c", "APPENDIX_C"),
    ("app c", "APPENDIX_C"),
    ("database", "APPENDIX_C"),
    ("radius", "APPENDIX_C"),
    ("edr", "APPENDIX_C"),
    ("appendix d", "APPENDIX_D"),
    ("app d", "APPENDIX_D"),
    ("historical", "APPENDIX_D"),
    ("appendix e", "APPENDIX_E"),
    ("app e", "APPENDIX_E"),
    ("agency", "APPENDIX_E"),
    ("public agency", "APPENDIX_E"),
    ("reports after e", "REPORTS_AFTER_E"),
    ("supporting reports", "REPORTS_AFTER_E"),
    ("reports", "REPORTS_AFTER_E"),
    ("appendix f", "APPENDIX_F"),
    ("app f", "APPENDIX_F"),
    ("qualifications", "APPENDIX_F"),
]

# --- files ---------------------------------------------------------------------------------------------------------

# extension, converter (None: already in page form)
SUPPORTED_EXTENSIONS = [
    (".pdf", None),
    (".docx", "office"),
    (".doc", "office"),
    (".vsd", "office"),
    (".vsdx", "office"),
    (".heic", "heic"),
    (".heif", "heic"),
    (".jpg", "image"),
    (".jpeg", "image"),
    (".png", "image"),
    (".tiff", "image"),
    (".tif", "image"),
    (".txt", "text"),
]
ARCHIVE_EXTENSIONS = [".zip"]
SKIPPED_EXTENSIONS = [".mov", ".mp4", ".avi", ".db", ".dbf"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".heic", ".heif", ".tiff", ".tif", ".gif", ".bmp"]
WORD_EXTENSIONS = [".docx", ".doc"]

# Rules on the extension alone: extensions, section, confidence, reason.
PREFILTER = [
    ([".heic", ".heif"], "APPENDIX_E", 0.99, "iPhone site photograph — supporting evidence"),
    ([".vsd", ".vsdx"], "APPENDIX_A", 0.99, "Visio file — site map or plot plan"),
]

# --- filename rules ------------------------------------------------------------------------------------------------

IMAGE_RULES = [
    (r"aerial", "APPENDIX_D", "aerials", "Aerial photograph"),
    (r"sanborn", "APPENDIX_D", "sanborn", "Sanborn map scan"),
    (r"topo", "APPENDIX_D", "topos", "Topographic map scan"),
    (r"site.?location.?map|location.?map", "APPENDIX_A", None, "Site location map"),
    (r"site.?plot.?plan|plot.?plan", "APPENDIX_A", None, "Site plot plan"),
    (r"site.?map", "APPENDIX_A", None, "Site map"),
]
NAME_RULES = [
    (r"sanborn", "APPENDIX_D", "sanborn", "Sanborn map"),
    (r"esai[_-]?aerials?", "APPENDIX_D", "aerials", "ESAI aerial photograph"),
    (r"aerials?[_-]?\d*\.pdf", "APPENDIX_D", "aerials", "Aerial photograph"),
    (r"aerial", "APPENDIX_D", "aerials", "Aerial photograph"),
    (r"esai[_-]?sanborn", "APPENDIX_D", "sanborn", "ESAI Sanborn map"),
    (r"esai[_-]?topos?[_-]?\d*", "APPENDIX_D", "topos", "ESAI topographic map"),
    (r"topo", "APPENDIX_D", "topos", "Topographic map"),
    (r"esai[_-]?city[_-]?dir", "APPENDIX_D", "city_directory", "ESAI city directory"),
    (r"city.?dir", "APPENDIX_D", "city_directory", "City directory"),
    (r"esai[_-]?radius", "APPENDIX_C", None, "ESAI radius/database report"),
    (r"esai[_-]?report", "COVER_WRITEUP", None, "ESAI report document"),
    (r"radius", "APPENDIX_C", None, "Radius/database report"),
    (r"site.?location.?map", "APPENDIX_A", None, "Site location map"),
    (r"site.?plot.?plan|plot.?plan", "APPENDIX_A", None, "Site plot plan"),
    (r"photo.?appendix|site.?photo", "APPENDIX_B", None, "Site photographs"),
    (r"e[\&\.\s]o\b|^eo[\s_-]|insurance.*coverage|errors.*omissions", "EO_INSURANCE", None, "E&O insurance"),
    (r"\breliance\b", "RELIANCE_LETTER", None, "Reliance letter"),
    (r"^cover\.", "COVER_WRITEUP", None, "Cover page"),
    (r"qualification", "APPENDIX_F", None, "Professional qualifications"),
    (r"property.?detail|property.?profile", "APPENDIX_E", None, "Property profile"),
    (r"records?.?request", "APPENDIX_E", None, "Records request"),
    (r"bldg.?permit|building.?permit", "APPENDIX_E", None, "Building permits"),
    (r"dtsc.?response", "APPENDIX_E", None, "DTSC response"),
    (r"baaqmd", "APPENDIX_E", None, "BAAQMD records"),
    (r"case\s*#?\s*\d{4,}", "APPENDIX_E", None, "Regulatory case file"),
]
FOLDER_RULES = [
    (r"bla-\d+", "BLA folder - supporting records"),
    (r"ec_attachments", "EC Attachments - compliance records"),
    (r"smeh_", "SMEH folder - environmental records"),
    (r"geotracker", "GeoTracker records"),
    (r"site.?documents", "Site documents"),
]
CAMERA_NAMES = [r"^\d{8}_\d+", r"^img_\d+", r"^dscn?\d+", r"^p\d{7}", r"^photo", r"^pxl_\d+"]
DIVIDER_WORDS = ["cover", "divider", "tab", "separator"]
DIVIDER_MAX_BYTES = 50 * 1024
BODY_EXCLUDES = r"aerial|sanborn|topo|city.?dir|radius"
PROFILE_NAME = r"property.?detail|property.?profile"
REVISED = r"\brev\b|\brevised\b"

# Steps that turn a lower-case stem into the name shared by all its versions: each match is removed in turn.
VERSION_MARKS = [
    r"[_\-\s]*(?:v|rev|version)\s*\d+",
    r"\s*\((?:revised|updated|final|draft|copy|\d+)\s*\d*\)",
    r"[_\-\s]*(?:final|draft|copy|revised|updated)$",
    r"[_\-]rev[_\-][a-z]{2,4}$",
    r"[_\-\s]+$",
]
# Marks removed before revised and older files are matched.
REVISION_MARKS = r"[-_\s]*(revised|rev|v\d+|final|draft)[-_\s]*"

# --- page text -----------------------------------------------------------------------------------------------------

HINT_PATTERNS = {
    "sanborn": [r"sanborn", r"fire.*insurance.*map", r"insurance map", r"sanborn-perthes"],
    "aerials": [r"aerial", r"orthophoto", r"orthoimagery", r"air photo", r"usgs.*photo"],
    "topos": [r"topographic", r"topo.*map", r"usgs.*quad", r"quadrangle", r"contour.*map"],
    "city_directory": [r"city.*director", r"city directory", r"polk.*director", r"business directory"],
}
PROFILE_PATTERNS = [
    r"property.*detail",
    r"property.*profile",
    r"title company report",
    r"preliminary title report",
    r"property information",
]
PROJECT_ID_PATTERNS = [
    r"project\s*(?:id|#|number)?:?\s*([0-9a-z\-]{4,})",
    r"(?:bla|ec|smeh|fa)\s*[-_]?\s*([0-9a-z]{7,})",
    r"^([0-9]{7,10})\b",
]
HINT_NOTE = (" [Subcategory from content: ", "]")
PROFILE_NOTE = " [Property Profile — ranked first in Appendix E]"
ADDRESS_PATTERN = r"(\d+\s+\w+\s+(?:street|st|avenue|ave|road|rd|drive|dr|boulevard|blvd))"
# pattern, group that holds the name
COMPANY_PATTERNS = [
    (r"©\s*(\w+(?:\s+\w+)*)", 1),
    (r"(environmental|engineering|consulting)\s+(\w+(?:\s+\w+)*)", 2),
]
COMPILED_MARKERS = [
    ["property location map", "plot plan"],
    ["site photographs", "photographs"],
    ["database report", "radius report"],
    ["historical records"],
    ["agency records", "public agency"],
    ["qualifications of environmental"],
]
COMPILED_TOC = "table of contents"
COMPILED_PHASE = ["phase i", "phase 1 environmental"]
COMPILED_PAGES = 30
COMPILED_MIN_BYTES = 5 * 1024 * 1024
COMPILED_REASON = (
    "Auto-excluded: detected as a previously compiled report (contains TOC + multiple appendix markers)"
)

# Words that speak for a section, taken from the section descriptions of the reference shape.
SECTION_EVIDENCE = [
    ("RELIANCE_LETTER", ["reliance letter", "third party", "may rely"]),
    ("EO_INSURANCE", ["certificate of liability", "acord", "policy number", "coverage"]),
    ("COVER_WRITEUP", ["table of contents", "executive summary", "findings", "conclusions", "recommendations"]),
    ("APPENDIX_A", ["location map", "plot plan", "site map"]),
    ("APPENDIX_B", ["photo appendix", "site photographs", "adjacent properties"]),
    ("APPENDIX_C", ["radius", "database", "lust", "rcra", "cerclis"]),
    ("APPENDIX_D", ["sanborn", "aerial", "topographic", "city directory"]),
    ("APPENDIX_E", ["permit", "agency", "property profile", "inspection report", "records request"]),
    ("REPORTS_AFTER_E", ["monitoring report", "site investigation", "closure", "remediation"]),
    ("APPENDIX_F", ["qualifications", "resume", "certifications", "licenses"]),
]

# Supporting reports worth keeping, strongest class first: class, pattern on the file name.
KEY_REPORT_CLASSES = [
    ("closure", r"closure|no further action|nfa"),
    ("tank_removal", r"tank removal|ust removal"),
    ("initial", r"initial|site investigation|phase ii"),
    ("monitoring", r"monitoring|quarterly|geotracker|q[1-4]"),
]
