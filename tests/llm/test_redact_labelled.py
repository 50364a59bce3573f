"""Recall and precision on labelled lines: every form of each kind behind usual cues, among lines that only look alike."""

import random

import pytest

from netquarry.llm import redact as R

GIVEN = ["Mirko", "Orla", "Ivo", "Brita", "Élodie", "Seán", "José", "Anna", "Łukasz", "Zoë", "Ines", "Pavel", "Tomas", "Greta", "Ulf"]
FAMILY = ["Valdane", "Quennick", "Tessendorf", "Harlaström", "O'Brien", "McKenzie", "Martin", "Kowalczyk", "Núñez", "Smith-Holm", "Dragan", "Ostrava", "Pelletier"]
PLAIN = ["// Clock Tree Synthesis runs before Static Timing", "# see Figure 12 and Table 4", "localparam WIDTH = 32;", "* THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY", "assign y = a & b;", "build 2025-12-18 of tag v2.14.3", "range 100-2000 step 5",
         "listen 127.0.0.81:6042", "git clone git@code.example:team/tool.git", "require left-pad@1.3.0", "// Power Delivery Network", "id 4711-12", "if (x == 12345678) return;", "# Gate Level Netlist", "timeout 600-1200 ms", "crc 0x99AF12", "serial 99-1234-5678-12"]


def lines(rnd):
    """(line, [(kind, text)]) with the truth known by construction."""
    g, f = rnd.choice(GIVEN), rnd.choice(FAMILY)
    ascii_f = R.fold(f).replace("'", "").replace("ł", "l")
    ascii_g = R.fold(g).replace("ł", "l")
    box = f"{ascii_g}.{ascii_f}@{rnd.choice(['lab.example', 'corp.test', 'chips.example.org'])}"
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    mark = rnd.choice(["// ", "# ", "* ", "-- "])
    form = rnd.randrange(26)
    if form < 4:
        name = [f"{g} {f}", f"{f}, {g}", f"{g} {rnd.choice('ABKLM')}. {f}", f"{g[0]}. {f}"][form]
        return f"{mark}{rnd.choice(['Author', 'Maintainer', 'Contact', 'Reviewed-by'])}: {name} <{box}>", [("name", name), ("email", box)]
    if form == 4:
        return f"{mark}Copyright 20{n(2)}, {g} {f}. All rights reserved", [("name", f"{g} {f}")]
    if form == 5:
        name = f"{g} {rnd.choice(['van der', 'de la', 'von'])} {f}"
        return f"{mark}Author: {name} <{box}>", [("name", name), ("email", box)]
    if form == 6:
        name = f"{g} {f}".upper()
        return f"{mark}Author: {name} <{box}>", [("name", name), ("email", box)]
    if form == 7:
        name = f"{g} {f} {rnd.choice(FAMILY)}"
        return f"{mark}Author: {name} <{box}>", [("name", name), ("email", box)]
    if form == 8:
        name = rnd.choice(["Иван Петров", "Мария Соколова", "Νίκος Παππάς"])
        return f"{mark}Author: {name} <{box}>", [("name", name), ("email", box)]
    if form < 12:
        spelt = [box, box.replace("@", " [at] ").replace(".", " [dot] "), box.replace("@", "(at)")][form - 9]
        if form == 10:
            spelt = box.split("@")[0] + " [at] " + box.split("@")[1].replace(".", " [dot] ")
        return f"{mark}mail {spelt} for help", [("email", spelt)]
    if form < 19:
        s = [f"+{rnd.choice(['44 20', '49 30', '1 415'])} {rnd.choice('123456789')}{n(3)} {n(4)}", f"({n(3)}) 555-{n(4)}", f"{rnd.choice('2345678')}{n(2)}-555-{n(4)}", f"0{n(3)} {n(3)} {n(4)}", f"1-800-555-{n(4)}", f"555-{n(4)}", f"0049-{n(2)}-{n(5)}-{n(3)}"][form - 12]
        return f"{mark}{rnd.choice(['tel', 'phone', 'fax'])}: {s}", [("phone", s)]
    if form < 23:
        s = [f"{n(3)}-{n(2)}-{n(4)}", f"QQ {n(2)} {n(2)} {n(2)} C", f"X{n(9)}Z", f"{rnd.choice(['AB', 'KT'])}{n(7)}"][form - 19]
        return f"{mark}{rnd.choice(['passport', 'national id', 'tax id'])} {s}", [("id_number", s)]
    s = [f"{rnd.randrange(1, 9999)} Pennsylvania Avenue NW", f"{rnd.randrange(1, 99)}, rue Ostquiti", f"Flat {rnd.randrange(1, 40)}, {rnd.randrange(1, 300)} Modrefla Road"][form - 23]
    return f"{mark}address: {s}", [("address", s)]


@pytest.fixture(scope="module")
def labelled():
    rnd = random.Random(11)
    docs, truth = [], set()
    for d in range(500):
        text = []
        for _ in range(4):
            if rnd.random() < 0.5:
                text.append(rnd.choice(PLAIN))
            else:
                line, spans = lines(rnd)
                text.append(line)
                truth |= {(d, k, s) for k, s in spans}
        docs.append((d, "\n".join(text), 0))
    return docs, truth


def test_recall_and_precision(spark, labelled):
    docs, truth = labelled
    got = {tuple(r) for r in R.find(spark.createDataFrame(docs, "doc_id long, text string, at long")).select("doc_id", "pii_kind", "found_text").collect()}
    figures = {}
    for kind in ("email", "phone", "id_number", "address", "name"):
        want, have = {t for t in truth if t[1] == kind}, {t for t in got if t[1] == kind}
        figures[kind] = (round(len(want & have) / len(want), 3), round(len(want & have) / max(1, len(have)), 3), sorted(want - have)[:6], sorted(have - want)[:6])
    print(figures)
    assert all(r >= 0.9 and p >= 0.9 for r, p, _, _ in figures.values()), figures


def test_redacted_texts_hold_no_found_span(spark, labelled):
    docs, _ = labelled
    df = spark.createDataFrame([(*d, "kept") for d in docs], "doc_id long, text string, at long, found_text string")
    found = R.find(df).collect()
    out = {r.doc_id: r for r in R.redact(df).collect()}
    assert len(out) == len(docs) and all(r.found_text == "kept" for r in out.values())
    for r in found:
        assert f"[{r.pii_kind.upper()}]" in out[r.doc_id].text
        assert r.found_text not in out[r.doc_id].text or docs[r.doc_id][1].count(r.found_text) > 1


def test_both_ways_of_redacting_agree(spark, labelled, monkeypatch):
    df = spark.createDataFrame(labelled[0], "doc_id long, text string, at long")
    monkeypatch.setattr(R, "ALONE_BITS", 1e9)
    one = {r.doc_id: r.text for r in R.redact(df).collect()}
    monkeypatch.setattr(R, "MOST_JUDGED", 0)
    assert {r.doc_id: r.text for r in R.redact(df).collect()} == one


def test_the_corpus_overrules_a_shape(spark):
    """A number shaped like a phone number is none behind a cue that nearly always has other numbers behind it."""
    docs = [(i, f"// lot {i:03d} 20{i % 10} 77{i % 7}1 9", 0) for i in range(600)] + [(9000, "// lot +44 20 7946 0158", 0), (9001, "// tel: +44 20 7946 0158", 0)]
    got = {(r.doc_id, r.found_text) for r in R.find(spark.createDataFrame(docs, "doc_id long, text string, at long")).filter("pii_kind = 'phone'").collect()}
    assert got == {(9001, "+44 20 7946 0158")}


def test_words_left_alone_are_generalised(spark):
    docs = [(i, f"# Author: Mirko Valdane <mirko.valdane@lab{i}.test>\nx = {i}", 0) for i in range(60)] + [(100 + i, "// Clock Tree Synthesis\n# Power Domain", 0) for i in range(300)] + [(999, "# ask Valdane about the Clock", 0)]
    out = {r.doc_id: r.text for r in R.redact(spark.createDataFrame(docs, "doc_id long, text string, at long")).collect()}
    assert out[999] == "# ask [PERSON] about the Clock"


def test_many_spans_in_one_text_take_linear_time():
    import time

    line = "// Author: Mirko Valdane <mirko.valdane@lab.test> tel +44 20 7946 0158\n"
    took = []
    for n in (1000, 8000):
        began = time.perf_counter()
        assert len(R.candidates(line * n)) == 3 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 25 * took[0]
