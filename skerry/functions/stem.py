"""English stemming by Porter's rules (Porter 1980), as one SQL expression that Spark and DuckDB both run."""

from __future__ import annotations

# Classes of letters: a consonant run, a vowel run, and from them the measure of a stem.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
VOWEL = f"^({_C})?[aeiouy]"
MEASURE_1 = f"^({_C})?{_V}{_C}"  # at least one vowel-consonant sequence
ONLY_1 = f"^({_C})?{_V}{_C}({_V})?$"
MEASURE_2 = f"^({_C})?{_V}{_C}{_V}{_C}"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"  # consonant, vowel, consonant
DOUBLE = [2 * x for x in "bcdfghjkmnpqrtvwx"]

# Suffixes and what takes their place, by step; of suffixes that end alike the longer comes first.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
          "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
          "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


class Dialect:
    """How an engine tests a pattern and an ending, and binds a name to a value."""

    def __init__(self, test: str, end: str, bind: str):
        self.test, self.end, self.bind = test, end, bind

    def like(self, value: str, pattern: str) -> str:
        return self.test.format(value=value, pattern=pattern)

    def ends(self, value: str, *ends: str) -> str:
        return "(" + " or ".join(f"{self.end}({value}, '{x}')" for x in ends) + ")"

    def let(self, name: str, value: str, body: str) -> str:
        return self.bind.format(name=name, value=value, body=body)


SPARK = Dialect("({value} rlike '{pattern}')", "endswith", "element_at(transform(array({value}), {name} -> {body}), 1)")
DUCK = Dialect("regexp_matches({value}, '{pattern}')", "ends_with", "list_extract(list_transform([{value}], lambda {name}: {body}), 1)")


def _cut(v: str, n: int) -> str:
    return f"left({v}, length({v}) - {n})"


def _suffixes(v: str, rules: dict[str, str], measure: str, d: Dialect) -> str:
    """The longest of the suffixes that the word has is replaced if what is before it has the measure."""
    cases = []
    for end in sorted(rules, key=lambda x: (-len(x), x)):
        stem = _cut(v, len(end))
        cases.append(f"when {d.ends(v, end)} then case when {d.like(stem, measure)} then concat({stem}, '{rules[end]}') else {v} end")
    return f"case {' '.join(cases)} else {v} end"


def stem_sql(word: str, d: Dialect) -> str:
    """SQL of the stem of a lower-case word; words of one or two letters and words with other characters stay."""
    def plural(v: str) -> str:
        return f"case when {d.ends(v, 'sses', 'ies')} then {_cut(v, 2)} when {d.ends(v, 's')} and not {d.ends(v, 'ss')} then {_cut(v, 1)} else {v} end"

    def past(v: str) -> str:
        bare = f"case when {d.ends(v, 'ed')} then {_cut(v, 2)} else {_cut(v, 3)} end"
        mended = (f"case when not {d.like('b', VOWEL)} then {v} when {d.ends('b', 'at', 'bl', 'iz')} then concat(b, 'e') when {d.ends('b', *DOUBLE)} then {_cut('b', 1)} "
                  f"when {d.like('b', SHORT)} then concat(b, 'e') else b end")
        return (f"case when {d.ends(v, 'eed')} then case when {d.like(_cut(v, 3), MEASURE_1)} then {_cut(v, 1)} else {v} end "
                f"when {d.ends(v, 'ed', 'ing')} then {d.let('b', bare, mended)} else {v} end")

    def last_y(v: str) -> str:
        return f"case when {d.ends(v, 'y')} and {d.like(_cut(v, 1), VOWEL)} then concat({_cut(v, 1)}, 'i') else {v} end"

    def fourth(v: str) -> str:
        ion = f"when {d.ends(v, 'ion')} then case when {d.ends(v, 'sion', 'tion')} and {d.like(_cut(v, 3), MEASURE_2)} then {_cut(v, 3)} else {v} end"
        return _suffixes(v, dict.fromkeys(STEP_4, ""), MEASURE_2, d).replace("case ", f"case {ion} ", 1)

    def last_e(v: str) -> str:
        s = _cut(v, 1)
        return f"case when {d.ends(v, 'e')} and ({d.like(s, MEASURE_2)} or ({d.like(s, ONLY_1)} and not {d.like(s, SHORT)})) then {s} else {v} end"

    def last_l(v: str) -> str:
        return f"case when {d.ends(v, 'll')} and {d.like(v, MEASURE_2)} then {_cut(v, 1)} else {v} end"

    out = "w8"
    steps = [plural, past, last_y, lambda v: _suffixes(v, STEP_2, MEASURE_1, d), lambda v: _suffixes(v, STEP_3, MEASURE_1, d), fourth, last_e, last_l]
    for i, step in reversed(list(enumerate(steps))):
        out = d.let(f"w{i + 1}", step(f"w{i}"), out)
    return f"case when {d.like(word, '^[a-z]{3,}$')} then {d.let('w0', word, out)} else {word} end"
