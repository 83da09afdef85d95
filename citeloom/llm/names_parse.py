"""Parsing of one typed name into folded tokens; plain Python, run in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

#: Words before a surname that may be left out or moved.
PARTICLES = frozenset("de del della der den di da dos du la le van von zu ter ten af al el bin ibn".split())
#: Titles and degrees; they are no part of a name.
TITLES = frozenset("dr prof professor mr mrs ms sir phd md msc bsc dphil esq".split())
#: Words that mark an organisation, with their short forms.
ORG_WORDS = {
    "department": "department", "dept": "department", "institute": "institute", "inst": "institute", "institut": "institute",
    "laboratory": "laboratory", "lab": "laboratory", "labs": "laboratory", "university": "university", "univ": "university",
    "foundation": "foundation", "fdn": "foundation", "found": "foundation", "collaboration": "collaboration", "collab": "collaboration",
    "center": "centre", "centre": "centre", "ctr": "centre", "consortium": "consortium", "group": "group", "team": "team",
    "society": "society", "soc": "society", "academy": "academy", "acad": "academy", "association": "association",
    "assoc": "association", "college": "college", "coll": "college", "school": "school", "network": "network",
    "council": "council", "agency": "agency", "organization": "organisation", "organisation": "organisation", "org": "organisation",
    "company": "company", "corp": "corporation", "corporation": "corporation", "inc": "incorporated", "ltd": "limited",
}
ORG_STOP = frozenset("of the and for in at on".split())
#: Nicknames of English given names, each with the full names it may stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan alexander", "alec": "alexander", "alex": "alexander alexandra", "andy": "andrew",
    "angie": "angela", "annie": "anne", "barb": "barbara", "becca": "rebecca", "becky": "rebecca", "ben": "benjamin",
    "bernie": "bernard", "bert": "albert herbert robert", "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth",
    "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "brad": "bradley", "cathy": "catherine",
    "charlie": "charles", "chris": "christopher christine christina", "chuck": "charles", "cindy": "cynthia", "dan": "daniel",
    "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "debby": "deborah", "dick": "richard",
    "don": "donald", "doug": "douglas", "drew": "andrew", "ed": "edward edwin", "eddie": "edward", "fran": "frances",
    "frank": "francis", "fred": "frederick", "freddy": "frederick", "gabe": "gabriel", "gene": "eugene", "ginny": "virginia",
    "greg": "gregory", "hal": "harold", "hank": "henry", "harry": "harold henry", "jack": "john", "jake": "jacob",
    "jamie": "james", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jess": "jessica", "jim": "james",
    "jimmy": "james", "joe": "joseph", "joey": "joseph", "johnny": "john", "jon": "jonathan", "josh": "joshua", "judy": "judith",
    "kate": "katherine catherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "kim": "kimberly",
    "larry": "lawrence", "len": "leonard", "lex": "alexander", "libby": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth",
    "maggie": "margaret", "marge": "margaret", "matt": "matthew", "max": "maximilian", "meg": "margaret", "mick": "michael",
    "mike": "michael", "mandy": "amanda", "nate": "nathaniel", "ned": "edward", "nick": "nicholas", "pam": "pamela",
    "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pete": "peter", "phil": "philip", "ray": "raymond",
    "rich": "richard", "rick": "richard", "rob": "robert", "robbie": "robert", "ron": "ronald", "sam": "samuel samantha",
    "sandy": "sandra alexander", "steph": "stephanie", "steve": "stephen steven", "stu": "stuart", "sue": "susan", "susie": "susan",
    "ted": "edward theodore", "terry": "terence", "tim": "timothy", "toby": "tobias", "tom": "thomas", "tommy": "thomas",
    "tony": "anthony", "tricia": "patricia", "trish": "patricia", "vic": "victor victoria", "vicki": "victoria", "vicky": "victoria",
    "vince": "vincent", "walt": "walter", "wally": "walter", "will": "william", "zach": "zachary", "zack": "zachary",
}

#: Given names that the list above knows, short and full: none of them is a typing error of another.
GIVEN_NAMES = frozenset(NICKNAMES) | {w for full in NICKNAMES.values() for w in full.split()}

_LATEX = re.compile(r"\\(?:[\"'`^~=.]|[uvHcdbtkrUVCDBTKR](?![a-zA-Z]))\s*\{?\s*\\?([a-zA-Z])\s*\}?")
_HYPHENS = re.compile(r"[\u2010-\u2015\u2212]")
_SPECIAL = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


_MACRO = re.compile(r"\\(aa|ae|oe|ss|o|l|i|j|AA|AE|OE|O|L)(?![a-zA-Z])\s*")
_MACROS = {"aa": "a", "AA": "A"}


def plain_letters(text: str) -> str:
    """The text without accents, braces and LaTeX macros for letters; case is kept."""
    text = _LATEX.sub(r"\1", text)
    text = _MACRO.sub(lambda m: _MACROS.get(m[1], m[1]), text)
    text = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    return re.sub(r"[{}]", "", text)


def parse(spelling: str) -> tuple[str, list[str], list[str], bool]:
    """(kind, full tokens, initials, has particle) of a spelling.

    kind is `org` or `person`; full tokens are sorted for an organisation and in typed order for a person, and
    leave out particles and titles; initials are in typed order. A token with a hyphen keeps it.
    """
    plain = _HYPHENS.sub("-", plain_letters(spelling))
    plain = plain.replace("\\&", " and ").replace("&", " and ").replace("~", " ")
    plain = re.sub(r"[\u2018\u2019'`\"]", "", plain)
    words = re.findall(r"[^\W_]+(?:-[^\W_]+)*", plain)
    low = [w.lower().translate(_SPECIAL) for w in words]
    # an organisation by its kind, or, should that word be misspelt, by a word that no person's name has
    if len(low) >= 3 and any(w in ORG_WORDS or w in ("of", "for") for w in low):
        return "org", sorted({ORG_WORDS.get(w, w) for x in low for w in x.split("-") if w not in ORG_STOP}), [], False
    long = sum(len(w) > 3 for w in low)
    shouting = all(x.isupper() for x in words if len(x) > 3)  # then capitals say nothing about initials
    full, initials, particle = [], [], False
    for raw, w in zip(words, low):
        short = len(w) <= 3 and raw.isupper() and "-" not in w
        if w in TITLES and not (short and long < 2):
            continue
        if not w[0].isalpha():
            continue
        if w in PARTICLES and long and not (long < 2 and (short or w in NICKNAMES)):
            particle = True
        elif all(len(x) == 1 for x in w.split("-")):
            initials.extend(w.split("-"))
        elif short and (w not in NICKNAMES or (len(w) == 2 and not shouting)) or len(w) == 2 and w not in NICKNAMES and long:
            initials.extend(w)
        else:
            full.append(w)
    return "person", full, initials, particle


def links(spelling: str) -> tuple[str, list[str], str, list[str], list[str]]:
    """(form, keys, middle, holds, asks) of a spelling; spellings of one form differ in nothing that counts.

    keys: the token sets, as text, by which full names are the same; the first is the form's own, others
    leave out, join or part the halves of a double surname. middle: initials beyond full tokens. holds: for full
    names, token|initial pairs by which a short form may mean it. asks: for short forms (initials only, nicknames), the
    pairs or keys that it may mean.
    """
    kind, full, initials, _ = parse(spelling)
    if kind == "org":
        key = " ".join(full)
        return "o:" + key, ["o:" + key], "", [], []
    halves = [w.split("-") for w in full]
    joined = ["".join(h) for h in halves]
    middle = "".join(initials)
    form = "p:" + " ".join(sorted(full)) + ":" + middle
    if len(full) < 2:
        if not full or not initials:
            return form, [], "", [], []
        return form, [], middle[1:], [], sorted({f"{t}|{initials[0]}" for t in {joined[0], halves[0][0]}})
    sets = [joined]
    if any(len(h) > 1 for h in halves):
        sets += [[h[0] for h in halves], [x for h in halves for x in h]]
    keys = list(dict.fromkeys("p:" + " ".join(sorted(s)) for s in sets))
    # the second half of a double surname is no given name, and three parted tokens do not tell which is
    holds = sorted({f"{t}|{s[j][0]}" for s in sets[: 2 if len(full) == 2 else 0] for i, t in enumerate(s) for j in range(len(s)) if i != j})
    asks = []
    for i, t in enumerate(joined):
        for whole in NICKNAMES.get(t, "").split():
            asks += ["p:" + " ".join(sorted([whole, *s[:i], *s[i + 1 :]])) for s in sets if len(s) == len(joined)]
    return form, keys, middle, holds, sorted(set(asks))
