"""Negation triggers: the published English base lists and the additions for pathology and endoscopy reports."""

# Base lists (Chapman et al. 2001 and its clinical English term set).
PSEUDO = [
    "no further", "not able to be", "not certain if", "not certain whether", "not necessarily",
    "without any further", "without difficulty", "without further", "might not", "not only", "no increase",
    "no significant change", "no change", "no definite change", "not extend", "not cause", "gram negative",
    "not drain", "no interval change", "no significant interval change",
]
PRECEDING = [
    "absence of", "declined", "denied", "denies", "denying", "no sign of", "no signs of", "not",
    "not demonstrate", "symptoms atypical", "doubt", "negative for", "no", "versus", "without", "doesn't",
    "doesnt", "don't", "dont", "didn't", "didnt", "wasn't", "wasnt", "weren't", "werent", "isn't", "isnt",
    "aren't", "arent", "cannot", "can't", "cant", "couldn't", "couldnt", "never", "patient was not",
    "without indication of", "without sign of", "without signs of", "without any reactions or signs of",
    "no complaints of", "no evidence of", "no cause of", "evaluate for", "fails to reveal", "free of",
    "never developed", "never had", "did not exhibit", "rules out", "rule out", "rule him out",
    "rule her out", "rule patient out", "rule the patient out", "ruled out", "ruled him out", "ruled her out",
    "ruled patient out", "ruled the patient out",
]
FOLLOWING = [
    "declined", "unlikely", "was not", "were not", "wasn't", "wasnt", "weren't", "werent", "was ruled out",
    "were ruled out", "free",
]
TERMINATION = [
    "although", "apart from", "as there are", "aside from", "but", "except", "however", "involving",
    "nevertheless", "still", "though", "which", "yet", "cause for", "cause of", "causes for", "causes of",
    "etiology for", "etiology of", "origin for", "origin of", "origins for", "origins of", "other possibilities of",
    "reason for", "reason of", "reasons for", "reasons of", "secondary to", "source for", "source of",
    "sources for", "sources of", "trigger event for",
]

# Additions for both report kinds.
PSEUDO_ADDED = ["not limited to", "not excluded", "needs to be ruled out", "although not apparent"]
PRECEDING_ADDED = ["negative", "insufficient", "without evidence of", "rather than", "precludes"]
FOLLOWING_ADDED = [
    "negative", "ruled out", "less likely", "is not", "are not", "does not", "have not", "was not", "were not",
    "absent", "not present",
]
TERMINATION_ADDED = ["note:", ";", ", negative", ",negative"]

# Additions for endoscopy and colon reports only.
PSEUDO_COLON = ["with absent"]
PRECEDING_COLON = ["history"]
FOLLOWING_COLON = ["no longer present"]

# A mention that begins with one of these loses it and changes polarity.
LEADING = ["no ", "non-", "non "]
