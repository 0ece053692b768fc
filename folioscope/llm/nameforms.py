"""Forms of a typed name: what two spellings of one name have in common.

``forms(name)`` gives rows (kind, key, a, b). Kinds with a key that stands for the whole name:

* ``full``  - the letters of all parts in the typed order, parts turned round, nicknames written out;
* ``sound`` - the same for romanised or original Korean names, with romanisations levelled;
* ``joined`` - a name typed as one word, which may be a whole name without blanks or a single part of one.

Kinds that need a whole name of the same book beside them:

* ``initial`` - initials and a surname; ``given`` - one part only; ``cut`` - a part and the other's initial;
* ``short`` - a shortened first part and a surname; ``acronym`` - initials of an organisation; ``head`` - an
  organisation without its kind.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Lists of words. -------------------------------------------------------------------------------------
TITLES = set("dr doctor captain capt sir lady lord master elder mr mrs ms miss madam madame prof professor don doña dona dom senhor senhora señor señora monsieur mademoiselle".split())
#: Kinds of organisations, and their short forms.
KINDS = set("guild association academy brotherhood division company house society order league union council corporation institute school club group agency bureau sect clan".split())
SHORT_KINDS = {
    "assoc": "association", "acad": "academy", "bros": "brotherhood", "bro": "brotherhood", "div": "division", "co": "company", "gld": "guild",
    "hse": "house", "soc": "society", "corp": "corporation", "inst": "institute", "pub": "publishing",
}
NICKNAMES = {
    "alexander": "alex al sandy xander sasha lex", "alexandra": "alex sandra sasha lexi", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs",
    "benjamin": "ben benny benji", "catherine": "cathy kate katie cat kit kitty", "charles": "charlie chuck chas", "charlotte": "lottie charlie",
    "christina": "chris tina chrissy", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie",
    "dorothy": "dot dottie dolly", "edward": "ed eddie ned ted teddy", "eleanor": "ellie nell nora", "elizabeth": "liz lizzie beth betty eliza bess bessie lisa libby betsy",
    "frances": "fran frannie", "francis": "frank fran", "frederick": "fred freddie freddy rick fritz", "gabriel": "gabe", "gabriella": "gabi gabby ella bella gabbie",
    "george": "georgie", "gregory": "greg", "helen": "nell nellie", "henry": "harry hank hal", "isabella": "izzy bella isa ella belle", "jacob": "jake",
    "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon nathan", "joseph": "joe joey", "josephine": "jo josie posy fina",
    "judith": "judy", "katherine": "kate kathy katie kat kit kitty kay", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "leo len lenny",
    "leonardo": "leo nardo lenny", "margaret": "maggie meg peg peggy greta marge margie daisy madge", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nat nate nathan",
    "nicholas": "nick nicky", "patricia": "pat patty tricia trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rebecca": "becky becca",
    "richard": "rick dick rich richie", "robert": "bob rob bobby robbie bert", "ronald": "ron", "samuel": "sam sammy", "stephen": "steve", "susan": "sue susie",
    "susannah": "sue susie suzie susan anna sukie zanna hannah", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky tori vic vicki toria", "vincent": "vince",
    "walter": "walt wally", "william": "will bill billy liam willie willy",
}
#: Romanised Korean surnames, before levelling.
SURNAMES = """kim lee yi park pak choi choe jung jeong kang gang jo cho yoon yun jang lim im han oh seo shin sin kwon hwang ahn an song ryu yoo
hong jeon ko go moon mun son yang bae baek heo nam sim noh no ha joo ju gu koo woo min jin cha chae won bang byun gong seok sun seol ma gil
yeon wi pyo myung ki ban wang geum ok yuk in maeng je mo tak guk eo eun pyeon do bong bing paeng gal mok noe dan ho""".split()

INITIALS = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
FINALS = " k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split(" ")
#: Characters typed for letters that look like them.
LOOKALIKES = str.maketrans("10358", "loesb")
# --------------------------------------------------------------------------------------------------------------------

_FORMAL: dict[str, list[str]] = {}
for _formal, _short in NICKNAMES.items():
    for _s in _short.split():
        _FORMAL.setdefault(_s, []).append(_formal)


def _syllable(c: str) -> str:
    i = ord(c) - 0xAC00
    return INITIALS[i // 588] + VOWELS[i % 588 // 28] + FINALS[i % 28]


_LEVEL = [
    (re.compile(p), r)
    for p, r in (
        ("wh", "hw"), ("oo|eo|eu", "u"), ("ae|ai|ay|ei", "a"), ("oe|oi", "o"), ("oa", "o"), ("(?<![hgk])w(?=u)", ""), ("ark", "ak"),
        ("(?<=[aeiou])h(?=[^aeiouwy]|$)", ""), ("p", "b"), ("t", "d"), ("k|q", "g"), ("l", "r"), (r"(.)\1+", r"\1"),
    )
]


@lru_cache(maxsize=100_000)
def level(letters: str) -> str:
    """Romanisations of one Korean name come out alike: byul and byeol, ping and bing, choh and cho."""
    for pattern, to in _LEVEL:
        letters = pattern.sub(to, letters)
    return letters


_SURNAMES = {level(s) for s in SURNAMES}


def fold(text: str) -> str:
    """Letters without accents, in lower case, with digits that stand for letters put right."""
    t = unicodedata.normalize("NFKD", text).replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l")
    return "".join(c for c in t if not unicodedata.combining(c)).lower().translate(LOOKALIKES)


def parts_of(name: str) -> tuple[list[str], bool]:
    """Words of a Latin name in natural order (titles and articles gone), and whether the order is certain."""
    t = unicodedata.normalize("NFKC", name)
    t = "".join(" " if unicodedata.category(c) == "Zs" else c for c in t if unicodedata.category(c) != "Cf")
    t = re.sub(r"(?<=[^\W\d_])(?<=[^A-Z\W])(?=[A-Z])", " ", t)  # two words typed as one
    t = re.sub(r"\s+", " ", fold(t)).strip(" .;:-")
    t = re.sub(r"[‘’`´']", "", t)
    sure = False
    if m := re.fullmatch(r"(.+?)\s*\((.+)\)", t):
        t, sure = f"{m[2]} {m[1]}", True
    elif m := re.fullmatch(r"([^,]+),\s*([^,]+)", t):
        t, sure = f"{m[2]} {m[1]}", True
    elif m := re.fullmatch(r"(.+?) of (?:the )?(.+)", t):
        t, sure = f"{m[2]} {m[1]}", True
    words = re.findall(r"[^\s,]+", t)
    while len(words) > 1 and words[0].strip(".") in TITLES | {"the"}:
        words = words[1:]
    return words, sure


def initials_in(word: str) -> str:
    """Letters of a word that consists of initials only (``k.``, ``c.b.``, ``m``), else nothing."""
    if re.fullmatch(r"(?:[a-z]\.-?)+[a-z]?\.?|[a-z]", word):
        return re.sub(r"[^a-z]", "", word)
    return ""


def sound_initials(syllables: list[str]) -> str:
    """First letters of the two given syllables, levelled."""
    s = [level(x) for x in syllables if x]
    return "".join(x[0] for x in s if x)


def forms(name: str | None) -> list[tuple[str, str, str, str]]:
    if not name or not name.strip():
        return []
    hangul = re.findall(r"[가-힣]", name)
    if hangul and len(hangul) >= 0.6 * len(re.findall(r"[^\W\d_]", name)):
        s = [_syllable(c) for c in hangul]
        if len(s) < 3:
            return [("given", level("".join(s)), "", "")] if len(s) == 2 else []
        return [("sound", level("".join(s)), level(s[0]), level("".join(s[1:]))), ("soundletters", level(s[0]), sound_initials(s[1:]), "")]
    words, sure = parts_of(name)
    if not words:
        return []
    marks = [(w, initials_in(w)) for w in words]
    whole = [re.sub(r"[^a-z]", "", w) for w, i in marks if not i]
    whole = [w for w in whole if w]
    letters = "".join(i for _, i in marks)
    out: list[tuple[str, str, str, str]] = []
    if not whole:
        return [("acronym", letters, "", "")] if len(letters) >= 3 else []
    kind = SHORT_KINDS.get(whole[-1], whole[-1]) if words[-1].endswith(".") or whole[-1] in SHORT_KINDS else whole[-1]
    if len(whole) > 1:
        whole[-1] = kind
    organisation = whole[-1] in KINDS or len(whole) > 2 and not any(level(w) in _SURNAMES for w in (whole[0], whole[-1]))
    if letters and not (organisation and len(whole) > 1) and len(whole) == 1:
        # initials and one part: "b. pellstow", "pellstow, b. e.", "bing c.b.", "corlania t."
        out.append(("initial" if marks[0][1] else "cut", whole[0], letters, ""))
        if level(whole[0]) in _SURNAMES and len(letters) == 2:
            for x in {"w": "uh"}.get(letters[0], letters[0]):
                out += [("soundinitial", level(whole[0]), level(x) + level(y), "") for y in {"w": "uh"}.get(letters[1], letters[1])]
        return out
    if letters and organisation and marks[0][1]:
        return [("orginitial", "".join(whole), letters, "")]
    if len(whole) == 1:
        w = whole[0]
        out.append(("joined", w, "", ""))
        out.append(("given", w, "", ""))
        if 2 < len(w) < 5:
            out.append(("acronym", w, "", ""))
        bits = re.findall("[a-z]+", words[0])
        if len(bits) == 3 and level(bits[0]) in _SURNAMES:
            out.append(("sound", level(w), level(bits[0]), level("".join(bits[1:]))))
            out.append(("soundletters", level(bits[0]), sound_initials(bits[1:]), ""))
        elif "-" in words[0] or re.match("|".join(sorted(_SURNAMES, key=len, reverse=True)), level(w)):
            if len(bits) == 1:
                out.append(("soundjoined", level(w), "", ""))
            out.append(("soundgiven", level(w), "", ""))
        return out
    orders = [whole] if sure else [whole, [whole[-1], *whole[:-1]]]
    for k, order in enumerate(orders):
        out.append(("full", "".join(order), order[0], "".join(order[1:])))
        if not organisation and len(order) == 2:
            out += [("full", formal + order[1], formal, order[1]) for formal in _FORMAL.get(order[0], ())]
            out.append(("short", order[1], order[0], ""))
    if len(whole) <= 3 and not organisation or len(whole) == 2:
        first, last = level(whole[0]), level(whole[-1])
        pieces = [re.findall("[a-z]+", w) for w, i in marks if not i]
        if first in _SURNAMES and not sure:
            rest = level("".join(whole[1:]))
            out.append(("sound", level("".join(whole)), first, rest))
            out.append(("soundletters", first, sound_initials([x for p in pieces[1:] for x in p]), ""))
        if last in _SURNAMES:
            rest = level("".join(whole[:-1]))
            out.append(("sound", level(whole[-1] + "".join(whole[:-1])), last, rest))
            out.append(("soundletters", last, sound_initials([x for p in pieces[:-1] for x in p]), ""))
    if organisation:
        kinds = 2 if len(whole) > 3 and whole[-2] == "publishing" else 1
        out.append(("orghead", "".join(whole[:-kinds]), "".join(w[0] for w in whole), "".join(whole[1:])))
        out.append(("orgletters", "".join(w[0] for w in whole), "", ""))
    elif len(whole) == 2:
        out.append(("head", "".join(whole), "", ""))
    return out
