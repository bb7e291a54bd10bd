"""Fixed values of the report sections: sites, headings, markers and exclusions."""

# Sites whose reports follow the heading conventions below, and the one with a note section.
SITES = ["MGH", "BWH", "NWH", "FH", "NSM"]
NOTE_SITE = "MGH"

# Statuses of reports that are not final.
UNFINISHED_STATUS = [
    "Deleted", "Cancelled", "In Process", "Preliminary", "Hold", "Pending", "Unknown", "In Revision", "Not Verified",
]

# Final-diagnosis heading of a pathology report.
DIAGNOSIS_QUALIFIERS = ["Final", "Pathologic", "FINAL", "PATHOLOGIC"]
DIAGNOSIS_EXCLUSIONS = [
    "amend", "final diagnosis by", "clinical data", "cytogenetic", "reason for", "gross description", "original",
    "epithelial", "unsatisfactory for evaluation", "clinical history",
]
OTHER_EXAMINATION_WORDS = ["fetus", "fetopsy", "autopsy"]

# Start of the lower section. Exact case on the space-collapsed line, then any case on the
# space-collapsed line, then any case on the line as it is, then the whole line.
LOWER_SECTION_EXACT = ["CLINICAL DATA", "Final Diagnosis by", "Reports to:", "SPECIMEN TYPE:"]
LOWER_SECTION_ANY_CASE = [
    "by his/her signature below", "electronically signed out", "diagnosis by:", "gross description:",
    "o. r. consultation report:",
]
LOWER_SECTION_RAW = ["clinical diagnosis & history", "pathology dept report date/time"]
LOWER_SECTION_LINE = "Clinical History:"

# The line that names the specimen.
ORGAN_WORDS = ["liver", "hepatic"]
SPECIMEN_WORDS = [
    "biopsy", "biopsies", "lobe", "random", "non-focal", "nonfocal", "non focal", "core", "cores", "specimen", "mass",
    "lesion", "tissue", "parenchyma", "operation", "segment", "segments", "excision", "nodule", "explant",
    "resection", "hepatectomy", "lobectomy", "native",
]
RESECTION = "hepatectomy"
RESECTION_SIDES = ["left", "right", "partial", "central"]
SPECIMEN_LISTS = [r"^\s*[a-f][.].*\bliver\b", r"^\s*[a-f]/1.*\bliver\b", r"\bliver\b.*:"]
SPECIMEN_EXCLUSIONS = [
    "colon", "renal", "kidney", "flexure", "flex", "metastatic", "glomerulosclerosis", "lymph", "brush", "artery",
    "fluid", "cautery artifact", "duct", "clinical data", "gross description", "original pathologic", "fna",
    "aspiration", "bile", "history",
]
SPECIMEN_EXCLUDED_START = "specimen:"
PROSE_LOWER_WORDS = 3
PROSE_UPPER_WORDS = 3
MOST_LOWER_WORDS = 8

# First words of a note section.
NOTE_WORDS = ["note", "comment"]

# Endoscopy headings.
ENDOSCOPY_STARTS = ["findings:", "impression:"]
ENDOSCOPY_ENDS = [
    "recommendation:", "recommend:", "recommendations:", "procedure codes:", "procedure code(s):",
]
