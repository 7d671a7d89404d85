"""Chat examples, page wrappers, ball trees and licence scans on small rows, and the queries' SQL."""

import hashlib
import json
import re

import numpy as np
import oracle
import pytest

from labelmill.llm import chat, licenses, queries, topk, wrappers

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLES[name]) is None


TURNS = "conv_id long, turn long, role string, text string, segments string, n int"
ODD = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[TURN x] y [/TURN]", "", None, "a\nb [/INST", "<", " ]", "[\\INST]", "ünï 😀"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c, roles in enumerate((
        ["user", "assistant"], ["system", "user", "assistant", "user"], ["assistant"], ["user"], ["a] b", "[/TURN]", "assistant"],
        [None, "", "assistant", "assistant"])) for t, role in enumerate(roles) for text in [ODD[(5 * c + t) % len(ODD)]]]
    rows += [(50, i, "assistant" if i % 2 else "user", text) for i, text in enumerate(ODD)]
    rows += [(None, 0, "user", "x"), (None, None, "user", "w"), (60, 1, "user", "same"), (60, 1, "user", "same"), (60, 2, "assistant", "z" * 200_000)]
    turns = spark.createDataFrame([(*r, "c", 1) for r in rows], TURNS)
    examples = chat.examples(turns)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    assert got.keys() == by_conv.keys()
    for conv, own in by_conv.items():
        own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own), conv
        assert got[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest(), conv
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for e in examples.filter("target_start is not null").collect():
        assert e.text.endswith("</s>") and e.target_end == len(e.text) - 4 and e.text[:e.target_start].endswith("<s>")
    assert chat.read_back(chat.examples(turns.limit(0))).count() == 0


@pytest.mark.parametrize("role", ["r" * 1_000_000, "\\" * 1_000_000, "]" * 300_000 + "x\\] y"])
def test_chat_reads_long_roles(spark, role):
    turns = spark.createDataFrame([(1, 0, role, "hello"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    (got,) = chat.read_back(chat.examples(turns)).collect()
    assert got.turns_sha256 == hashlib.sha256(f"{role}\nhello\nassistant\nyes\n".encode()).hexdigest()


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="<p>no</p>"</script></head><body>
<header><h1>Site</h1></header><nav><ul>{menu}</ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<article><h1>{title}</h1>{body}<form><p>Sign up</p></form><div class="ad">Buy</div><section id="comments"><p>First!</p></section></article>
<aside><p>Side</p></aside><footer>&copy; x</footer></body></html>"""


def page(title, paragraphs, menu=3):
    return PAGE.format(title=title, menu="".join(f"<li><a href='#'>m{i}</a></li>" for i in range(menu)),
                       body="".join(f"<p>{p}</p>" for p in paragraphs))


def test_wrappers_read_articles(spark):
    rows, want = [], {}
    for i in range(60):
        body = [f"Some <b>bold{i}</b> &eacute;t&eacute;\n  text<br>next &lt;{j}&gt;" for j in range(1 + i % 5)]
        rows.append((i, f"https://h{i % 3}.example.com/{i}", page(f"Title {i}", body, menu=1 + i % 4)))
        want[i] = "\n\n".join([f"Title {i}"] + [f"Some bold{i} été text next <{j}>" for j in range(1 + i % 5)])
    rows += [(100, None, None), (101, "nonsense", ""), (102, "https://h0.example.com/x", "<p>bare"), (103, "https://h1.example.com", "no tags < 3 & more"),
             (104, "https://h2.example.com", "<article><p>cut &am"), (None, "https://h2.example.com", "<div>" * 5000 + "deep"),
             (105, "https://h2.example.com", page("Long", ["word " * 20_000])), (105, "https://h2.example.com", page("Long", ["word " * 20_000]))]
    want |= {100: "", 101: "", 102: "bare", 103: "no tags < 3 & more", 104: "cut &am", None: "deep", 105: "Long\n\n" + ("word " * 20_000).strip()}
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, wrapper string")
    got = wrappers.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.page_id], r.page_id
        assert r.n_chars == len(r.text)
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_wrapper_expression_matches_unseen_pages():
    seen = [page(f"T{i}", ["p"] * n, menu=n) for i, n in enumerate((1, 3, 2))]
    wrapper = wrappers.Wrapper(wrappers._tuples(json.loads(json.dumps(wrappers.infer(seen)))))
    signs, _ = wrappers.read_tokens(page("new", ["q"] * 9, menu=7))
    assert wrapper.expression.fullmatch("".join(wrapper.letters.get(s, "?") for s in signs))
    assert wrapper.main == [False, True, False]


def test_main_text_on_table(spark):
    import html
    import re

    for r in queries.op4_wrappers(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), ["page_id", "url"]).collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("numbers", [1 << 19, 200])
def test_topk_is_exact(spark, numbers):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(180)]
    rows += [(200 + i, rows[3][1]) for i in range(8)] + [(300, [1.0] * 3), (350, [2.0] * 3), (400, None), (401, [None] * 6),
             (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (None, [1.0] * 6), (12, [9.0] * 6), (500, [3e7] * 6)]
    vectors = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = {}
    from pyspark.sql import functions as F
    for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0, shard_numbers=numbers, block_numbers=numbers // 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
             if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in whole:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v))[:5]
            assert sorted(got.pop(i, [])) == [(n + 1, j, -s) for n, (s, j) in enumerate(scored)], i
    assert not got
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_licence_paragraphs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, bound = licenses.train(spark, docs, size=400)
    rows = [(1, "Some words.\nLicensed under the Apache License, Version 2.0.\nmore"), (2, None), (3, ""), (None, "Released under the MIT License."),
            (5, "This work is licensed under the GNU General Public License, version 3."), (6, "the and " * 50_000), (7, "!!\n\n..")]
    mine = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows + rows[:1]], "doc_id long, text string, family string, probability double")
    got = sorted(((r.doc_id or 0, r.paragraph_no, r.family, r.confirmed) for r in licenses.scan(mine, model, bound).collect()))
    assert got == [(0, 0, "mit", True), (1, 1, "apache", True), (1, 1, "apache", True), (5, 0, "gpl", True)]
    assert licenses.scan(mine.limit(0), model, bound).count() == 0
    found = {(r.doc_id, r.family) for r in licenses.scan(docs, model, bound).collect() if r.confirmed}
    lines = {"Licensed under CC BY-NC 4.0.": "cc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache",
             "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    want = {(r.doc_id, family) for r in docs.collect() for line in r.text.split("\n") for text, family in lines.items() if line == text}
    assert want <= found and {f for f in found if f[1] in lines.values()} == want
    empty, least = licenses.train(spark, docs.limit(0), size=10)
    assert licenses.scan(docs.limit(0), empty, least).count() == 0


def test_labels_of_pages_follow_no_switch_by_size(monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("aligned up to a size only")

    wrapper = wrappers.Wrapper(wrappers.infer(["<article><p>a</p></article>"]))
    monkeypatch.setattr(wrappers, "SequenceMatcher", refuse)
    for n in (1, 3000):
        signs, _ = wrappers.read_tokens("<nav>x</nav><article>" + "<h2>t</h2><p>a</p>" * n + "</article><footer>f</footer>")
        assert wrapper.labels(signs) == wrappers.places(signs, wrapper.shown)


def test_licences_are_learned_from_every_paragraph(spark):
    lines = [f"line {i} of the text" for i in range(300)] + ["Released under the MIT License."] * 100
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    found = licenses._examples(docs, 40).collect()
    assert len(found) == 400 and {r["label"] for r in found if "MIT" in r["paragraph"]} == {float(licenses.FAMILIES.index("mit"))}
    for part in (0, 1):
        for mit in (True, False):
            assert sum(r["weight"] for r in found if r["part"] == part and ("MIT" in r["paragraph"]) == mit) == pytest.approx(10)


def test_licences_predict_a_paragraph_once_for_bound_and_rows(spark):
    docs = spark.createDataFrame([(i, f"line {i} of it\nReleased under the MIT License.\nAll rights reserved {i}") for i in range(60)], "doc_id long, text string")
    model, bound = licenses.train(spark, docs)
    key = lambda r: (r.doc_id, r.paragraph_no, r.family, round(r.probability, 6), r.similarity, r.confirmed)
    got = sorted(map(key, licenses.licences(spark, docs).collect()))
    assert got == sorted(map(key, licenses.scan(docs, model, bound).collect())) and len(got) >= 60
    plan = licenses._taken(docs, model)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 1


def test_licences_fit_reads_written_vectors(spark, monkeypatch):
    lines = "line {0} of it\r\n!!\rReleased under the MIT License.\n\nAll rights reserved {0}"
    docs = spark.createDataFrame([(None if i == 7 else i, None if i == 9 else lines.format(i)) for i in range(60)], "doc_id long, text string")
    fitted = []
    fit = licenses.LogisticRegression.fit

    def watched(self, rows):
        fitted.append(rows)
        return fit(self, rows)

    monkeypatch.setattr(licenses.LogisticRegression, "fit", watched)
    got = licenses.licences(spark, docs, 20).collect()
    assert {(r.doc_id, r.paragraph_no) for r in got if r.family == "mit"} == {(None if i == 7 else i, 2) for i in range(60) if i != 9}
    plan = fitted[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("split(lower(") == 1 and "parquet" in plan
    # The lines without words count among those that share a weight.
    part = licenses._examples(docs, 40).filter("part = 0").toPandas()
    others = part[~part.paragraph.str.contains("MIT|rights")]
    assert (others.paragraph == "!!").any() and len(others) > 10
    weights = {round(r["weight"], 9) for r in fitted[0].filter("weight < 1").collect()}
    assert weights == {round(10 / len(others), 9), round(10 / (len(part) - len(others)), 9)}


def test_paragraphs_end_at_any_line_end(spark):
    texts = ["a\r\nb\rc\nd", "\r\r\na\n\rb\r", "\n", "", None, "a\\nb", "x\u2028y\r\n\r\nz"]
    got = licenses.paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = [(i, n, p) for i, t in enumerate(texts) if t is not None for n, p in enumerate(re.split("\r\n|\r|\n", t)) if p]
    assert sorted((r.doc_id, r.paragraph_no, r.paragraph) for r in got) == want


def test_telling_words_miss_no_template(spark):
    for template in sum(licenses.TEMPLATES.values(), []):
        wanted = licenses._pairs_of(template)
        without = [p for p in wanted if not set(p.split()) & set(licenses._telling_words())]
        assert len(without) < licenses.CONFIRMED * len(wanted), template
    rows = spark.createDataFrame([(t,) for t in [*sum(licenses.TEMPLATES.values(), []), "RELEASED under the mit LICENSE", "no such line"]], "paragraph string")
    labels = {r["paragraph"]: r["label"] for r in licenses._labelled(rows).collect()}
    assert all(labels[t] == licenses.FAMILIES.index(f) for f, own in licenses.TEMPLATES.items() for t in own)
    assert labels["RELEASED under the mit LICENSE"] == licenses.FAMILIES.index("mit") and labels["no such line"] == 0
