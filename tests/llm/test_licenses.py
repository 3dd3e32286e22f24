import random

from pyspark.sql import functions as F

from scoreloom.llm import licenses


TEXTS = [(name, t) for name, texts in licenses.TEMPLATES.items() for t in texts]


def slow_hits(text):
    """Templates that stand in the text word for word."""
    tokens = licenses.words(text or "")
    out = set()
    for name, t in TEXTS:
        w = licenses.words(t)
        if any(tokens[i : i + len(w)] == w for i in range(len(tokens))):
            out.add(name)
    return out


def test_every_template_is_found_wherever_it_stands():
    rnd, index = random.Random(1), licenses.Index(licenses.TEMPLATES)
    for name, t in TEXTS:
        for _ in range(5):
            before, after = (" ".join("".join(rnd.choices("abcdefg", k=5)) for _ in range(rnd.randint(0, 40))) for _ in range(2))
            text = f"{before}\n{t.upper() if rnd.random() < 0.3 else t}\n{after}"
            found = index.scan(text)
            hit = [m for m in found if m[0] == name]
            assert hit and hit[0][1] == 1.0, (name, found)
            assert licenses.words(text[hit[0][3] : hit[0][4]]) == licenses.words(t)


def test_edited_template_and_clean_text():
    index = licenses.Index(licenses.TEMPLATES)
    w = licenses.TEMPLATES["mit"][0].split()
    del w[10]
    w[25:26] = ["very", "odd"]
    found = index.scan("Some text. " + " ".join(w) + " more")
    assert [m[0] for m in found] == ["mit"] and 0.9 < found[0][1] < 1
    assert index.scan("under the license of the public, released by nobody " * 50) == []
    assert index.scan(None) == index.scan("") == index.scan("MIT License") == []


def edited(text, rnd, rate=0.06):
    """Random words replaced, left out or put in; versions, modifiers and names stay."""
    out = []
    for w in text.split():
        x = rnd.random()
        free = not set(licenses.words(w)) & (licenses.MODIFIERS | licenses.NAMES) and not any(c.isdigit() for c in w)
        if free and x < rate:
            out += {0: [], 1: ["changed"], 2: [w, "extra"]}[rnd.randint(0, 2)]
        else:
            out.append(w)
    return " ".join(out)


def test_recall_of_edited_texts():
    rnd, index = random.Random(7), licenses.Index(licenses.TEMPLATES)
    tried = caught = wrong = 0
    for name, t in TEXTS:
        if len(t.split()) < 5:
            continue
        for _ in range(6):
            found = {m[0] for m in index.scan(f"some text before it {edited(t, rnd)} and text after it")}
            tried, caught, wrong = tried + 1, caught + (name in found), wrong + bool(found - {name})
    assert caught >= 0.9 * tried and wrong <= 0.02 * tried, (tried, caught, wrong)


def test_rivals_are_told_apart():
    scan = lambda t: [m[0] for m in licenses.Index(licenses.TEMPLATES).scan(t)]
    notice = "This work is licensed under the GNU General Public License, version {}."
    assert scan(notice.format(2)) == ["gpl-2.0-notice"] and scan(notice.format(3)) == ["gpl-3.0-notice"] and scan(notice.format(7)) == []
    cc = "This work is licensed under a Creative Commons {} 4.0 International License."
    assert scan(cc.format("Attribution")) == ["cc-by-4.0-notice"]
    assert scan(cc.format("Attribution-NonCommercial")) == ["cc-by-nc-4.0-notice"]
    assert scan(cc.format("Attribution-NonCommercial-NoDerivatives")) == ["cc-by-nc-nd-4.0-notice"]
    assert scan("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0-notice"] and scan("Licensed under CC BY 3.0") == ["cc-by-3.0-notice"]
    for name in ("gpl-2.0-header", "gpl-3.0-header", "lgpl-2.1-header", "lgpl-3.0-header", "agpl-3.0-header", "bsd-2-clause", "bsd-3-clause", "0bsd", "isc"):
        assert scan(licenses.TEMPLATES[name][0]) == [name]


def test_drifting_match_is_one_match():
    """A word put in after each tenth moves the end by more than the band."""
    w = licenses.TEMPLATES["mit"][0].split()
    drifted = " ".join(x for i, word in enumerate(w) for x in ([word, "inserted"] if i % 10 == 9 else [word]))
    found = licenses.Index(licenses.TEMPLATES).scan(f"before {drifted} after")
    assert [m[0] for m in found] == ["mit"] and found[0][1] > 0.97 and len(w) // 10 > licenses.BAND
    assert len(licenses.words(f"before {drifted} after"[found[0][3] : found[0][4]])) >= len(w)


def test_spans_index_the_text_itself():
    text = "İİİİ ﬁ Σ Released under the MIT License. İ"
    found = licenses.Index(licenses.TEMPLATES).scan(text)
    assert [(m[0], text[m[3] : m[4]]) for m in found] == [("mit-notice", "Released under the MIT License")]


def test_whole_files_as_templates(tmp_path):
    body = " ".join(f"clause{i % 97} word{i}" for i in range(3000))
    (tmp_path / "Long-1").write_text(body)
    index = licenses.Index(licenses.templates_in(str(tmp_path)))
    assert [(m[0], m[1]) for m in index.scan(f"x {body} y")] == [("long-1", 1.0)]


def test_query_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        parts = [" ".join("".join(rnd.choices("abcde", k=4)) for _ in range(30))]
        for name in rnd.sample(sorted(licenses.TEMPLATES), rnd.randint(0, 2)):
            parts += [licenses.TEMPLATES[name][0], "gap words in between here"]
        rows.append((i if i % 9 else None, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "x " * 50_000 + licenses.TEMPLATES["isc"][0]), (102, "x " * 50_000 + licenses.TEMPLATES["isc"][0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.license) for r in licenses.scan(docs).where("coverage = 1").collect())
    expect = []
    for i, t in rows:
        names = slow_hits(t)
        names -= {"apache-2.0-notice"} if "apache-2.0-header" in names else set()  # the longer match covers it
        expect += [(i is None, i or 0, n) for n in names]
    assert sorted(set(got)) == sorted(set(expect)) and len(got) >= len(set(expect))
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
