"""Script profiles: the data that makes the operators work on a script.

An operator never names a letter; it reads classes, rule tables and flags from a
``ScriptProfile``.  ``KANNADA`` serves scanned Kannada, ``LATIN`` any Latin text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: White space as Python's ``str.strip`` sees it, and the line breaks of ``str.splitlines``.
SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BREAKS = r"\x{0D}\x{0A}|[\x{0A}-\x{0D}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


@dataclass(frozen=True)
class ScriptProfile:
    name: str
    word: str  # character classes, without brackets
    digit: str
    block: str  # what a lexicon entry may consist of
    normalise: tuple[tuple[str, str], ...] = ()  # (pattern, replacement with $1), in order
    suffixes: tuple[str, ...] = ()
    suffix_norm: tuple[tuple[str, str], ...] = ()  # (broken, sound)
    suffix_out: tuple[tuple[str, str], ...] = ()  # further spellings that a stripped suffix is reported under
    weak_suffixes: tuple[str, ...] = ()  # not enough for a word of up to ``weak_length``
    weak_length: int = 4
    stem_adds: tuple[str, ...] = ()
    verb_tail: tuple[str, str] = ("", "")  # a stem with this ending (3 or more characters) may gain that
    stem_swaps: tuple[str, ...] = ()  # replacements of the last of more than 3 characters
    initials: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    compound_adds: tuple[str, ...] = ()
    confusions: tuple[tuple[str, str, float], ...] = ()
    vowel_flips: tuple[tuple[str, str], ...] = ()
    consonants: str = ""
    virama: str = ""
    virama_exts: tuple[str, ...] = ()
    nasal: str = ""
    link_vowel: str = ""  # what a stem gains where a suffix attaches
    protected: tuple[str, ...] = ()
    auxiliaries: tuple[str, ...] = ()
    #: Sandhi, first match wins: (root endings, suffixes, suffix starts, characters cut from the root, text put
    #: between, suffix kept).  Empty suffixes and starts: any suffix.
    sandhi: tuple[tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], int, str, bool], ...] = ()
    flags: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def directed(self) -> list[tuple[str, str, float, int]]:
        """Confusions in both directions: (from, to, cost, order), the first of equal pairs."""
        out: dict[tuple[str, str], float] = {}
        for a, b, c in self.confusions:
            out.setdefault((a, b), c)
            out.setdefault((b, a), c)
        return [(a, b, c, i) for i, ((a, b), c) in enumerate(out.items())]

    @property
    def ranked_suffixes(self) -> list[str]:
        return sorted(self.suffixes, key=len, reverse=True)

    @property
    def reported(self) -> dict[str, str]:
        return dict(self.suffix_out) | dict(self.suffix_norm)


# Classes, suffixes, confusions and other rule data of Kannada.
_SUFFIXES = """
ಯೊಂದಿಗೆ ನೊಂದಿಗೆ ಗಳೊಂದಿಗೆ ಗಳಲ್ಲಿನ ಗಳಲ್ಲಿ ಗಳನ್ನು ಗಳಿಂದ ಗಳಿಗೆ ಗಳಿಗಾಗಿ ಗಳಿಗೂ ಗಳಿಗಿಂತ ಗಳ ಗಳು
ಯಲ್ಲಿನ ನಲ್ಲಿನ ದಲ್ಲಿನ ಯಲ್ಲಿದ್ದ ನಲ್ಲಿದ್ದ ದಲ್ಲಿದ್ದ ಯಲ್ಲಿ ನಲ್ಲಿ ದಲ್ಲಿ ಅಲ್ಲಿ ಯೊಡನೆ ನೊಡನೆ ದೊಡನೆ
ಅಂತಹವಳು ಅಂತಹವನು ಅಂತಹವರು ಅಂತಹ ಇಂತಹ ಆದಂತಹ ವರೆವಿಗೂ ವರೆಗೆ ತನಕ
ಅವರುಗಳು ಇವರುಗಳು ಅವರು ಇವರು ಅವರ ಇವರ ವರು ಯರು ಅರು ರು ಂದಿರು
ಯನ್ನು ನನ್ನು ವನ್ನು ನ್ನು ಅನ್ನು ವನು ಯನು ಯಿಂದ ನಿಂದ ದಿಂದ ಇಂದ
ಯಿಗೆ ನಿಗೆ ದಿಗೆ ಕ್ಕಾಗಿಯೊ ಕ್ಕಾಗಿಯೂ ಕ್ಕಾಗಿ ಗಾಗಿ ಕ್ಕೆ ಗೆ ಯಾಗಿಯೂ ವಾಗಿಯೂ ಯಾಗಿನ ವಾಗಿನ ಯಾಗಿ ವಾಗಿ
ಯೊಬ್ಬ ನೊಬ್ಬ ದೊಬ್ಬ ಒಬ್ಬ ಯೊಬ್ಬಳು ನೊಬ್ಬಳು ಯಲ್ಲ ನಲ್ಲ ದಲ್ಲ ಅಲ್ಲ ಆಗಿದೆ ಆಗಿ ಆಗಿದ್ದಾರೆ ಆಗಿದ್ದವು ಆದರೂ ಆದರೆ ಇದ್ದರೆ ಇದ್ದರೂ
ಯೂ ನೂ ದೂ ವೂ ಉ ಒ ವು ಯು ಯ ನ ದ ಅ
ಿಸುತ್ತವೆ ಿಸುತ್ತಾನೆ ಿಸುತ್ತಾಳೆ ಿಸುತ್ತಾರ ಿಸುತ್ತದೆ ಿಸುತ್ತೀರಿ ಿಸುತ್ತೇನೆ ಿಸುತ್ತೇವೆ
ುತ್ತವೆ ತ್ತಾನೆ ತ್ತಾಳೆ ತ್ತಾರೆ ುತ್ತದೆ ತ್ತೀರಿ ತ್ತೇನೆ ತ್ತೇವೆ ುತದೆ ುತಾರೆ ುತಾನೆ ುತಾಳೆ ಸುತದೆ
ಿಸಿದರು ಿಸಿದನು ಿಸಿದಳು ಿಸಿದವು ಿಸಿತು ಿದರು ಿದನು ಿದಳು ಿದವು ಿತು
ವಿತ್ತು ಯಿತ್ತು ಇತ್ತು ದ್ದವು ದ್ದರು ದ್ದನು ದ್ದಳು ಿಸಲು ಿಲು ುವುದು ಿಕೊಂಡು
"""
_SUFFIX_NORM = """
ುತದೆ ುತ್ತದೆ
ಸುತದೆ ಸುತ್ತದೆ
ುತಾರೆ ತ್ತಾರೆ
ುತಾನೆ ತ್ತಾನೆ
ುತಾಳೆ ತ್ತಾಳೆ
ವಳ್ಳು ವಳು
ಅಂತಹವಳ್ಳು ಅಂತಹವಳು
ಬಿಟ್ಟತ್ತು ಬಿಟ್ಟಿತ್ತು
ಟ್ಟತ್ತು ಟ್ಟಿತ್ತು
"""
_CONFUSIONS = """
ಕ ಖ .25, ಗ ಘ .25, ಚ ಛ .25, ಜ ಝ .25, ಟ ಠ .25, ಡ ಢ .25, ತ ಥ .25, ದ ಧ .25, ಪ ಫ .25, ಬ ಭ .25,
ಪ ವ .25, ಬ ವ .30, ನ ವ .25, ಮ ಯ .25, ಹ ಪ .25, ಹ ಷ .25, ಹ ಯ .20, ಶ ತ .22, ಲ ಳ .25, ಳ ಕ .22,
ಳ ಗ .35, ಣ ನ .25, ಶ ಷ .25, ಸ ಷ .25, ಶ ಸ .25, ರ ಠ .25, ರ ದ .30, ಜ ಪ .25, ತ ನ .35, ಥ ಫ .25, ದ ಞ .35,
ಅ ಆ .25, ಇ ಈ .25, ಉ ಊ .25, ಎ ಏ .25, ಒ ಓ .20, ಎ ವಿ .25,
ಎಜ ವಿ .22, ಎಿ ಅ .22, ಎಿ ವಿ .25, ವ್ಮ ಮ್ಮ .20, ಮ್ನ ಮ್ಮ .20, ಂಜ ಂದ .20, ಸ್ಮ ಷ್ಮ .20, ಸ್ಮೆ ಷ್ಮೆ .20,
ದ್ವ ಧ್ವ .20, ಸರ ಸ್ತರ .20, ಸಂ ಸಾ .22
"""
_FLIPS = "ಿೀ ುೂ ೆೇ ೊೋ ಅಆ ಇಈ ಉಊ ಎಏ ಒಓ"
_VERB_TAILS = "ಸುತ್ತದೆ ಸುತ್ತಾರೆ ಸುತ್ತಾನೆ ಸುತ್ತಾಳೆ ಸುತ್ತವೆ ಸುತ್ತೇನೆ ಸುತ್ತೇವೆ ಸಿದರು ಸಿದನು ಸಿದಳು ಸಿದವು ಸಿತು"
_U, _I = "ು", "ಿ"
#: Each long verb ending has a short spelling: with the u sign before -ttade and -ttave, without it before
#: other -tta-, with the i sign before -da- and -tu.
_SHORT = {"ಸುತ್ತದೆ": "ುತ್ತದೆ", "ಸುತ್ತವೆ": "ುತ್ತವೆ"}


def _verb_rules():
    for tail in _VERB_TAILS.split():
        short = _SHORT.get(tail) or (tail[2:] if tail.startswith("ಸು") else tail[1:])
        yield (("ಿಸು", "ಿಸಿ"), (_I + tail, short), (), 3, _I + tail, False)


KANNADA = ScriptProfile(
    name="kannada",
    word="ಀ-೥‌‍",
    digit="೦-೯",
    block="ಀ-೿‌‍",
    # Runs of digit zero and nasal sign, letter e with an i sign, a quote before white space; then the
    # archaic r sign, which moves before its letter.
    normalise=(
        ("[೦ಂ]+", "ಂ"),
        ("ಎ[ಿೀ]", "ಅ"),
        (f'^[«“"][{SPACE}]+', "“"),
        ("([ಅ-ಹ][ಾ-ೖ]?)೯", "ರ್$1"),
    ),
    suffixes=tuple(_SUFFIXES.split()),
    suffix_norm=tuple(tuple(x.split()) for x in _SUFFIX_NORM.strip().split("\n")),
    suffix_out=(("ವನು", "ವನ್ನು"), ("ಯನು", "ಯನ್ನು")),
    weak_suffixes=("ಯ", "ದ", "ನ", "ಅ", "ಉ", "ವು"),
    stem_adds=(_I, _U, "ಾ", "ೆ"),
    verb_tail=("ಿಸ", _U),
    stem_swaps=(_I, "ೆ", _U),
    initials=tuple("ವಿ ಡಾ ಶ್ರೀ ಪ್ರೊ ಎ ಆ ಈ ಏ ಓ ಒ ಎಸ್ ಜಿ ಕೆ ಪಿ ಟಿ ಎಂ ಎಲ್ ಆರ್ ಬಿ ಸಿ ಡಿ ಹೆಚ್ ಎನ್".split()),
    prefixes=tuple("ಮರು ಅನು ಪ್ರತಿ ಉಪ ಸಹ ಅಸಹ ಸು ದುರ್ ವಿ ಮಹಾ ಏಕ ಸರ್ವ ಆದಿ ಅಂತರ್".split()),
    compound_adds=("", _U, "ಾ", _I),
    confusions=tuple((a, b, float(c)) for a, b, c in (x.split() for x in _CONFUSIONS.strip().split(","))),
    vowel_flips=tuple((x[0], x[1]) for x in _FLIPS.split()),
    consonants="ಕಖಗಘಙಚಛಜಝಞಟಠಡಢಣತಥದಧನಪಫಬಭಮಯರಱಲವಶಷಸಹಳೞ",
    virama="್",
    virama_exts=("ೆ", "ಾ", _U, "ಣ", "ಮಿ", _I),
    nasal="ಂ",
    link_vowel=_U,
    protected=tuple("ಶ್ರೀ ಡಾ ಪ್ರೊ ಆ ಈ ಏ ಮತ್ತು ಹಾಗೂ ಅಥವಾ ಎಂದು ಎಂಬ ಒಂದು ಆಗಿದೆ ಆಗಿದ್ದಾರೆ ಆಗುವುದು ಆಗಿದೆ. ಇದೆ ಇದು ಅಲ್ಲ ಇಲ್ಲ".split()),
    auxiliaries=tuple("ವಾಗಿ ವಾಗಲು ವಾಗುವುದು ವಾಗಬೇಕಿದೆ ವಾಗಿದೆ ವಾಗುತ್ತದೆ".split()),
    sandhi=(
        *_verb_rules(),
        ((_U,), (), ("ತ್ತ",), 0, "", True),
        ((_U,), ("ಿಸುತ್ತದೆ", "ುತ್ತದೆ"), (), 1, "ಿಸುತ್ತದೆ", False),
        ((_U,), (), tuple("ಿ ೀ ೆ ೇ ಅ ಇ ಉ ಎ ಒ".split()), 1, "", True),
        ((_U,), ("ಗೆ",), (), 1, "ಿಗೆ", False),
    ),
)

LATIN = ScriptProfile(
    name="latin",
    word="A-Za-zÀ-ÖØ-öø-ÿ",
    digit="0-9",
    block="a-zà-öø-ÿ",
    normalise=(("ﬁ", "fi"), ("ﬂ", "fl")),
    suffixes=tuple("tion ing ment able ly ed er es s".split()),
    suffix_norm=(("mcnt", "ment"), ("tlon", "tion"), ("lng", "ing")),
    weak_suffixes=("s", "ed"),
    stem_adds=("e",),
    verb_tail=("at", "e"),
    stem_swaps=("y",),
    initials=("mr", "dr", "st"),
    prefixes=tuple("un re pre sub over".split()),
    compound_adds=("", "s"),
    confusions=(("rn", "m", 0.2), ("cl", "d", 0.2), ("vv", "w", 0.2), ("l", "i", 0.25), ("c", "e", 0.25), ("u", "v", 0.3), ("h", "b", 0.3), ("n", "u", 0.35)),
    vowel_flips=(("e", "é"), ("a", "à"), ("o", "ó")),
    consonants="dnrst",
    virama="'",
    virama_exts=("s",),
    nasal="~",
    link_vowel="e",
    protected=("the", "of", "and"),
    auxiliaries=("self", "selves"),
    sandhi=((("e",), (), ("i", "e", "a"), 1, "", True),),
)
