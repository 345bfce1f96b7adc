"""The token pattern, stop words, stemmer suffixes, scripts."""

from __future__ import annotations

#: One alternation, tried in this order at each place: URL, mention, hashtag, number, e-mail, word.
#: No look-around, so that Java and RE2 read it alike; Spark adds ``(?U)`` for Unicode white space.
W = r"\p{L}\p{N}'’"
TOKEN_KINDS = {
    "url": r"https?://\S*[^\s.,;:!?)\]}]|https?://|www\.\S*[^\s.,;:!?)\]}]",
    "mention": r"@[\p{L}\p{N}_\-]+",
    "hashtag": r"#[\p{L}\p{N}_\-]+",
    "number": r"[0-9](?:[0-9.,:/\-]*[0-9/\-])?",
    "email": rf"[{W}][{W}._+\-]*@[{W}@_+\-](?:[{W}@._+\-]*)\.(?:[{W}@._+\-]*)[{W}@_+\-]",
    "word": rf"[{W}]+",
}
TOKEN = "|".join(TOKEN_KINDS.values())

# English stop words.
STOP_EN = (
    "a about after all also an and any are as at be because been but by can do for from had has have he "
    "her his how i if in into is it its just me more my no not of on or our out she so some than that "
    "the their them then there these they this to up us was we were what when which who will with would you your"
).split()
# Stop words of German, French and Spanish.
STOP_DE = "aber als am an auch auf aus bei das dem den der des die ein eine einem einen einer es für hat ich im in ist mit nicht oder sich sie und von war wie wir zu".split()
STOP_FR = "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur mais nous ou par pas pour que qui sur un une vous".split()
STOP_ES = "a al como con de del el ella en es esa ese esta este la las lo los mas no nos o para pero por que se sin su sus un una y yo".split()
STOP_WORDS = {"en": STOP_EN, "de": STOP_DE, "fr": STOP_FR, "es": STOP_ES}

# Suffixes and what replaces them, the first that fits counts.
STEM_SUFFIXES = {
    "ization": "ize",
    "ational": "ate",
    "fulness": "ful",
    "ousness": "ous",
    "iveness": "ive",
    "tional": "tion",
    "biliti": "ble",
    "ing": "",
    "edly": "",
    "ed": "",
    "ies": "y",
    "sses": "ss",
    "s": "",
}

# Scripts by code points, as character classes.
SCRIPTS = {
    "Latin": r"A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}",
    "Greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}",
    "Cyrillic": r"\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}",
    "Hebrew": r"\x{0590}-\x{05FF}",
    "Arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}",
    "Devanagari": r"\x{0900}-\x{097F}",
    "Hiragana": r"\x{3040}-\x{309F}",
    "Katakana": r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}",
    "Han": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}",
    "Hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}",
}

# Entities of subtitles, decoded in this order.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}
# Tags that subtitles may carry.
SUBTITLE_TAGS = ("b", "c", "i", "lang", "rt", "ruby", "u", "v")
