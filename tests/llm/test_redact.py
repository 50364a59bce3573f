from netquarry.llm import redact as R

DOC = "doc_id long, text string, at long"
PEOPLE = [("Mirko Valdane", "mirko.valdane@lab.test"), ("Orla P. Quennick", "oquennick@corp.example"), ("Tessendorf, Ivo", "tessendorf_ivo at mail dot example dot net"), ("B. Harlaström", "brita.harlastrom+ci(at)lab(dot)test")]


def docs():
    out = []
    for i in range(40):
        n, m = PEOPLE[i % 4]
        out.append((i, f"# Author: {n} <{m}>\n# Copyright 2020, Fable Foundation. All rights reserved\nx = 1\n# Copyright 2021, {n}. All rights reserved", 0))
    out += [(100 + i, f"// tel: {p}\n", 0) for i, p in enumerate(["+44 20 7946 0158", "(934) 555-0129", "752-555-0163", "0049-30-23125-137", "+49 (0)30 23125 191", "07700 900130", "4535550181"])]
    out += [(200 + i, f"-- national id {x} belongs to nobody", 0) for i, x in enumerate(["QQ 32 97 49 C", "404.559.485-38", "998-27-9446", "963 29 1611", "X855425998Z"])]
    out += [(300 + i, f"/* address: {x}", 0) for i, x in enumerate(["42, rue Ostquiti", "Flat 17, 175 Modrefla Road", "7121 East Wexthalpax Way, Apt 87", "Cortrumirstraße 31", "6C Ylvel Close", "3513 Stadam St."])]
    out += [(400, "remote git@code.example:a/b.git pinned x_y@2.0.1 listen 127.0.0.81:6042 build 2025-12-18 v = 4535550181", 0), (401, None, 0), (402, "", 0), (403, "z" * 300_000, 0)]
    out += [(410 + i, "// Clock Tree Synthesis runs before Static Timing", 0) for i in range(30)]  # a heading is told by the corpus
    return out


def test_found(spark):
    d = docs()
    got = R.find(spark.createDataFrame(d + d[:5], DOC).dropDuplicates()).select("doc_id", "pii_kind", "found_text").distinct().collect()
    rows = {tuple(r) for r in got}
    assert {r for r in rows if r[0] >= 400} == set()
    for i in range(40):
        n, m = PEOPLE[i % 4]
        assert {r[1:] for r in rows if r[0] == i} == {("name", n), ("email", m)}
    assert {(r[1], r[2]) for r in rows if 100 <= r[0] < 200} == {("phone", x) for x in ["+44 20 7946 0158", "(934) 555-0129", "752-555-0163", "0049-30-23125-137", "+49 (0)30 23125 191", "07700 900130", "4535550181"]}
    assert {r[2] for r in rows if 200 <= r[0] < 300 and r[1] == "id_number"} == {"QQ 32 97 49 C", "404.559.485-38", "998-27-9446", "963 29 1611", "X855425998Z"}
    assert {r[2] for r in rows if 300 <= r[0] < 400} == {x[1][12:] for x in d if 300 <= x[0] < 400}


def test_redacted(spark):
    out = {r.doc_id: r.text for r in R.redact(spark.createDataFrame(docs(), DOC)).collect()}
    assert out[0] == "# Author: [NAME] <[EMAIL]>\n# Copyright 2020, Fable Foundation. All rights reserved\nx = 1\n# Copyright 2021, [NAME]. All rights reserved"
    assert out[100] == "// tel: [PHONE]\n" and out[300] == "/* address: [ADDRESS]" and out[401] is None and out[402] == ""


def test_redacted_the_same_however_many_words_are_judged(spark, monkeypatch):
    d = docs()
    d += [(500, "# as Valdane said, ask Quennick", 0), (0, "// a second text of number 0, by Orla P. Quennick <oquennick@corp.example>", 0), (None, "# Author: Mirko Valdane <mirko.valdane@lab.test>", 0)]
    d += [(1000 + i, "// Clock Tree Synthesis runs before Static Timing", 0) for i in range(400)]  # of all capitals few are names
    out = []
    for most in (R.MOST_JUDGED, 0):
        monkeypatch.setattr(R, "MOST_JUDGED", most)
        out.append(sorted(map(tuple, R.redact(spark.createDataFrame(d, DOC)).collect()), key=str))
    assert out[0] == out[1] and len(out[0]) == len(d)
    assert (500, "# as [PERSON] said, ask [PERSON]", 0) in out[0] and (None, "# Author: [NAME] <[EMAIL]>", 0) in out[0]


def test_empty(spark):
    e = spark.createDataFrame([], DOC)
    assert R.find(e).count() == 0 and R.redact(e).count() == 0
