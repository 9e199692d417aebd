import re

import pytest

from sensorloom.llm.license import PHRASES, TEMPLATES, TokenAutomaton, parse_template, scan_licenses, words_of

CASES = [
    (1, None), (2, ""), (3, "A. B!"),
    (4, "Released under the MIT License."), (5, "released UNDER the terms of the mit-license, yes; MIT License"),
    (6, "Licensed under the Apache License, Version 2.0."), (7, "x " * 60000 + "Licensed under CC BY-NC 4.0."),
    (8, "This work is licensed under the GNU General Public License, version 3."),
    (8, "This work is licensed under the GNU General Public License, version 3."),
    (9, "released under an MIT License"), (10, "GNU General\nPublic  License é apache license apache license"),
]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, lab) for p, lab in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
    return ws, places


def test_base_against_brute_force(docs_of):
    got = {(r.doc_id, r.n_words): r for r in scan_licenses(docs_of(CASES)).collect()}
    for i, t in CASES:
        ws, places = brute(t)
        r = got[(i, len(ws))]
        assert r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    labels = {r.doc_id: r.labels for r in got.values()}
    assert labels[5] == "mit,mit-notice" and labels[9] == "mit" and labels[8] == "gpl,gpl-3.0-notice"
    assert scan_licenses(docs_of(CASES)).count() == len(CASES)


def test_empty_table(docs_of):
    assert scan_licenses(docs_of([])).count() == 0


def test_automaton_regions():
    a = TokenAutomaton({"t": "one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> four <<var;max=2>> five"})
    yes = ["one four five", "one two four x five", "one two three four x y five", "one four x y five tail"]
    no = ["one three four five", "one four x y z five", "one four", "two four five"]
    assert all(a.run(words_of(s.encode()), 0) == {"t"} for s in yes)
    assert not any(a.run(words_of(s.encode()), 0) for s in no)


def test_bad_markup():
    for bad in ("a <<beginOptional>> b", "a <<endOptional>> b", "<<var;max=3>>"):
        with pytest.raises(ValueError):
            parse_template(bad)
    assert all(parse_template(t) for t in TEMPLATES.values())


def plain(markup, optional, fill):
    """A template as a text: optional regions in or out, replaceable ones filled with at most their words."""
    t = re.sub(r"<<beginOptional>>(.*?)<<endOptional>>", (lambda m: m[1]) if optional else "", markup)
    return re.sub(r"<<var;max=(\d+)>>", lambda m: " " + " ".join(fill[: int(m[1])]) + " ", t)


def test_whole_licences(docs_of):
    """Every template is found with its optional parts in and out and its replaceable ones filled; a changed, missing or added mandatory word hides it."""
    rows, fill = [], "the example authors and their many good friends of long ago today and more".split()
    names = sorted(TEMPLATES)
    for k, name in enumerate(names):
        for variant, (optional, words) in enumerate(((True, fill), (False, fill), (True, []), (False, fill[:1]))):
            rows.append((100 * k + variant, "Preamble. " + plain(TEMPLATES[name], optional, words).upper().replace(" ", "\n * ", 3) + " Tail."))
        words = plain(TEMPLATES[name], False, []).split()
        mandatory = [w for w in words_of(" ".join(words).encode())]
        at = len(words) // 2
        rows.append((100 * k + 50, " ".join([*words[:at], "intruder", *words[at:]])))
        rows.append((100 * k + 51, " ".join(words[:at] + words[at + 1 :])))
        assert mandatory
    got = {r.doc_id: r for r in scan_licenses(docs_of(rows)).collect()}
    for k, name in enumerate(names):
        assert all(name in got[100 * k + v].labels.split(",") and got[100 * k + v].score == 1 for v in range(4)), name
        assert not any(name in got[100 * k + v].labels.split(",") for v in (50, 51)), name
    assert len(names) >= 20


def test_regions_at_the_ends_do_not_matter():
    """A template is found as without its outer regions, and its automaton starts at mandatory words only."""
    from sensorloom.llm.license import TEMPLATES, TokenAutomaton

    assert TokenAutomaton(TEMPLATES).first is not None
    auto = TokenAutomaton({"x": "<<var;max=3>> <<beginOptional>>maybe<<endOptional>> may copy <<var;max=1>> it <<var;max=2>> <<beginOptional>>all<<endOptional>>"})
    assert auto.first == {b"may"}
    found = lambda text: {x for i in range(len(text)) for x in auto.run(text, i)}
    assert found(b"you may copy it".split()) == found(b"may copy all it".split()) == {"x"} and not found(b"may copy a b it".split())
