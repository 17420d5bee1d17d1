"""The registered queries on a small folder of tables, against brute force or what their pages and texts were made from."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from limpid.llm import decontaminate, html_extract, language_id, queries, secret_scan

WORDS = {
    "en": "the and with from this that have which their would there about could other after first people water between",
    "de": "der die und nicht mit sich auch nach einer haben werden zwischen durch gegen immer wieder zeit haus wasser",
    "fr": "les des une avec pour dans plus sont mais nous comme tout leurs entre apres toujours encore maison temps",
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "s", "en", "al"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    at = tmp_path_factory.mktemp("tables")
    items = [(k, prose(rng, "en", 25) + "? " + prose(rng, "en", 6)) for k in range(30)]
    line = "A line that many documents share, word for word."
    rows = []
    for k in range(150):
        lang = rng.choice(list(WORDS))
        rows.append((k, prose(rng, lang, rng.randrange(20, 120)), lang, f"s{k % 3 % 2}"))
    rows += [(200 + k, prose(rng, "en", 60) + "\n" + line + "\n" + prose(rng, "en", 9), "en", "s0") for k in range(5)]
    rows += [(300 + k, prose(rng, "en", 40) + " " + items[k][1] + " " + prose(rng, "en", 40), "en", "s1") for k in range(6)]
    copy = prose(rng, "fr", 80)
    rows += [(400 + k, copy if k % 2 else copy.upper(), "fr", "s0") for k in range(4)] + [(410, copy + " encore", "fr", "s0")]
    rows += [(500, None, None, "s0"), (501, "", "en", None), (502, "12 34", None, "s0"), (503, "password = hunter22x " + base64.b64encode(b"token=abcdefgh").decode(), "en", "s0"), (504, "x" * 60_000 + " the", "en", "s1"), (505, "同じ文" * 40, None, "s1")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "http://a.org/x", "<html><body><nav>Menu</nav><article><h1>T</h1><p>Some &amp; more, of it.</p></article></body></html>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at), rows, items


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder[0])


def norm(t):
    return (t or "").encode().lower()


def test_token_and_exact_queries(spark, folder):
    rows = folder[1]
    got = {r["doc_id"]: r for r in run(spark, folder, "op2_token_counts").collect()}
    assert len(got) == len(rows) and all(got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (got[i]["n_tokens"] > 4096) for i, t, *_ in rows)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    want = {(i, max(groups[norm(t)]), len(groups[norm(t)]), i == max(groups[norm(t)]), hashlib.sha256(norm(t)).hexdigest()) for i, t, *_ in rows}
    out = run(spark, folder, "op7_exact_dedup")
    assert {tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in out.collect()} == want


def test_quality_and_language_queries(spark, folder):
    rows = folder[1]
    got = run(spark, folder, "op1_quality_classifier").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows) and all(r["kept"] == (r["tail_probability"] >= 0.12) for r in got)
    got = {r["doc_id"]: r for r in run(spark, folder, "op6_language_id").collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r["held_out"] == (i in out) for i, r in got.items()) and all(0 <= r["score"] <= 1 for r in got.values())
    right = [got[i]["lang_pred"] == lang for i, t, lang, _ in rows if lang and i in out and i < 200]
    assert sum(right) >= 0.95 * len(right) > 20
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {500, 501, 502}


def test_html_and_decontamination_queries(spark, folder):
    assert {tuple(r) for r in run(spark, folder, "op3_html_extraction").collect()} == {(1, "http://a.org/x", "T\nSome & more, of it.", 21), (2, None, "", 0)}
    rows, items = folder[1:]
    got = run(spark, folder, "op4_benchmark_decontamination").collect()
    # brute force: a whole item word for word
    want = {i: {k for k, item in items if b" ".join(decontaminate.terms_of(item)) in b" ".join(decontaminate.terms_of(t))} for i, t, *_ in rows}
    assert {r["doc_id"]: set(r["item_ids"]) for r in got} == want and all(r["kept"] == (not want[r["doc_id"]]) != r["contaminated"] for r in got)


def test_secret_line_and_join_queries(spark, folder):
    rows = folder[1]
    got = {r["doc_id"]: r for r in run(spark, folder, "op8_secret_scans").collect()}
    for i, t, *_ in rows:
        base, spans = secret_scan.find_secrets(t or "")
        show = lambda x: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in x)
        assert got[i]["base_sha256"] == hashlib.sha256(show(base).encode()).hexdigest() and got[i]["spans"] == show(spans)
        assert [got[i][f"n_{k}"] for k in secret_scan.KINDS] == [sum(b[1] == j for b in base) for j in range(3)]
    assert got[503]["n_assign"] == 1 and got[503]["spans"].count("assign") == 2
    seen, keep = Counter(), {}
    keys = lambda t: [x.strip(b" \t\n\v\f\r") for x in norm(t).split(b"\n")]
    for i, t, *_ in rows:
        for k in {k for k in keys(t) if len(k.decode()) >= 20}:
            seen[k] += 1
            keep[k] = max(keep.get(k, -1), i)
    want = set()
    for i, t, *_ in rows:
        left = [x for x, k in zip((t or "").split("\n"), keys(t)) if seen[k] < 3 or keep[k] == i]
        want.add((i, len(keys(t)), len(keys(t)) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    assert {tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in run(spark, folder, "op9_line_dedup").collect()} == want

    def grams(t):
        w = norm(t).split()
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())

    sets = {i: grams(t) for i, t, *_ in rows}
    near = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])
    root = {i: i for i in sets}
    for _ in range(4):
        root = {i: min(root[j] for j in sets if i == j or near(i, j)) for i in sets}
    assert {tuple(r) for r in run(spark, folder, "op10_ngram_jaccard_join").collect()} == {(i, len(sets[i]), root[i]) for i in sets}


def test_mixing_query(spark, folder):
    rows = folder[1]
    got = run(spark, folder, "op5_source_mixing").collect()
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(norm(t).split())
    drawn, places = Counter(), defaultdict(list)
    for r in got:
        drawn[r["source"]] += r["n_tokens"]
        places[r["source"], r["epoch"]].append((r["block"], r["position"], r["doc_id"]))
    weights = {r["source"]: r["weight"] for r in got}
    assert abs(sum(weights.values()) - 1) < 1e-9 and all(r["n_tokens"] > 0 for r in got)
    for (s, e), x in places.items():
        assert len({d for *_, d in x}) == len(x)  # an epoch draws a document once
    orders = [[d for *_, d in sorted(x)] for (s, e), x in sorted(places.items(), key=str) if len(x) > 20]
    assert all(a[:10] != b[:10] for a, b in zip(orders, orders[1:]))


def test_epochs_have_orders_of_their_own(spark):
    from limpid.llm import mixing

    df = spark.createDataFrame([(k, "w " * 10, "a") for k in range(64)] + [(99, "same words", "b")] * 5 + [(None, "x y", None), (7, None, "a"), (8, " ", "b")], "doc_id long, text string, source string")
    out = mixing.mix_sources(df, entropy=None, repetitions=None, budget=3840, block_tokens=40, bucket_docs=4).collect()
    first, second = ([r["doc_id"] for r in sorted((r for r in out if r["source"] == "a" and r["_epoch"] == e), key=lambda r: (r["_block"], r["_order"]))] for e in (0, 1))
    assert sorted(first) == sorted(second) == list(range(64)) and first != second
    where = [{r["doc_id"]: r["_block"] - min(x["_block"] for x in out if x["source"] == "a" and x["_epoch"] == e) for r in out if r["source"] == "a" and r["_epoch"] == e} for e in (0, 1)]
    assert where[0] != where[1]
    assert sum(r["source"] == "b" and r["_epoch"] == 0 for r in out) == 5 and any(r["source"] is None for r in out)
    assert mixing.mix_sources(df, budget=0).count() == 0
    given = mixing.mix_sources(df.withColumn("n", F.lit(3)), tokens_col="n").collect()
    assert {r["_tokens"] for r in given} == {3} and sum(r["doc_id"] == 7 for r in given) > 0
    dense = spark.createDataFrame([("同じ文 and two",), ("one two",), (None,)], "t string").select(mixing.token_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in dense] == [5, 2, 0]


def test_planted_secrets_are_found():
    rng = random.Random(21)
    codes = {
        "url": lambda s: "".join(f"%{b:02X}" for b in s.encode()), "escape": lambda s: "".join(f"\\u{ord(c):04x}" for c in s if ord(c) < 0x10000),
        "base64": lambda s: base64.b64encode(s.encode()).decode(), "gzip": lambda s: base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode(), "zlib": lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
        "word": lambda s: "".join(f"%{b:02x}" if rng.random() < 0.3 else chr(b) for b in s.encode()),
    }
    found = total = 0
    for _ in range(400):
        hidden = rng.choice(["password=hunter22x", 'token: "abcdef123"', "AKIA" + "Q" * 16, "0f1e" * 8])
        for _ in range(rng.randrange(1, 5)):
            hidden = codes[rng.choice(list(codes))](hidden)
        before = prose(rng, "de", rng.randrange(5)) + " é% "
        text = f"{before}{hidden} {prose(rng, 'fr', 4)}"
        total += 1
        found += any(a < len(before) + len(hidden) and b > len(before) for a, k, b in secret_scan.find_secrets(text)[1])
    assert found >= 0.99 * total, (found, total)


def test_base_spans_equal_a_naive_scanner():
    kinds = [r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+"]
    rng = random.Random(5)
    pieces = ["password", "Token", "api_key", "=", ": ", "'", "abcdef", "x", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef01234567", "é", "\n", " ", "K", "secret"]
    for _ in range(3000):
        t = "".join(rng.choices(pieces, k=rng.randrange(12)))
        want = []
        for kind, p in enumerate(kinds):
            at = 0
            while m := re.compile(p, re.I | re.A if kind == 0 else 0).search(t, at):
                ok = len(m[1]) >= 6 if kind == 0 else len(m[0]) >= (20 if kind == 1 else 24)
                want += [(m.start(), kind, m.end())] * ok
                at = m.end()
        assert secret_scan.scan(t) == sorted(want), t


def test_deep_escapes_take_linear_time():
    import time

    for text in ("password=%" + "25" * 4000 + "41bcdefg", "password=\\" + "u005c" * 2000 + "u0041bcdefg", "password=" + "%2" * 2000 + "%35" + "5" * 2000):
        began = time.time()
        spans = secret_scan.find_secrets(text)[1]
        assert time.time() - began < 2
        assert "%2%2" in text or (0, 0, len(text)) in spans
    assert secret_scan.Layer("%25%34%31 %%34%31 \\x5cu00e9 %c3%a9 %zz %", [(0, 0, None)]).resolved().text == "A A é é %zz %"
    lower = base64.b64encode(b"i\xb7\x1dy\xf8\xa9i\xb7\x1dy\xf8\xa9").decode()
    assert lower.isalpha() and list(secret_scan._runs(lower + " " + "a" * 30))[1][0] == "a" * 30  # words of letters are tried too


def test_long_words_are_read_whole():
    word = "ab" * 40
    a, b = (language_id.word_features(w, {}) for w in (word + "xyz" + word, word + "uvw" + word))
    assert a != b and len(a) > 2 * len(word)
    model = language_id.train({"en": [prose(random.Random(1), "en", 300)], "fr": [prose(random.Random(2), "fr", 300)]}, steps=20)
    long = "".join(WORDS["fr"].split() * 4)
    assert language_id.predict([long], model)[0][0] == "fr" and language_id.predict([long + " " + long], model)[0][0] == "fr"
    known, strange = (language_id.predict([t], model)[0][2] for t in (prose(random.Random(3), "en", 50), "цбфщ xqzj wvkq ржйд" * 9))
    assert known > 0.9 > 0.6 > strange


def test_samples_are_bounded(spark):
    rows = [(None, "the same words here", "en")] * 300 + [(None, f"the text {k}", "en") for k in range(50)] + [(k, f"le texte {k}", "fr") for k in range(500)] + [(9, "x" * 300, "fr"), (5, None, "fr"), (6, "no label", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    from limpid.llm.common import bounded_sample

    sample = lambda **o: bounded_sample(df, F.col("lang"), F.col("doc_id"), F.col("text"), **{"per_label": 20, "bytes_per_label": 200, "max_labels": 5, **o})
    got = sample()
    assert set(got) == {"en", "fr"} and all(1 <= len(x) <= 20 and sum(map(len, x)) <= 400 and len(set(x)) == len(x) for x in got.values()) and got == sample()
    assert len(sample(bytes_per_label=10_000)["fr"]) == 20
    with pytest.raises(ValueError):
        sample(max_labels=1)
    assert language_id.fit(df).langs == ["en", "fr"]


def test_items_of_any_id(spark):
    rng = random.Random(2)
    items = [(f"i-{k}", prose(rng, "en", 20) + "? " + prose(rng, "de", 6)) for k in range(12)]
    bench = spark.createDataFrame([*items, items[3], (None, "one two three four five six. seven eight nine ten")], "item_id string, text string")
    df = spark.createDataFrame([(1, f"x {items[3][1]} y", {"odd": 1}), (2, "z one two three four five six. seven eight nine ten", None), (3, None, None)], "doc_id int, text string, m map<string,int>").select("doc_id", "text", F.struct(F.lit(1).alias("odd name")).alias("s"))
    for options in ({}, {"shard_items": 4}, {"shard_bytes": 400}):
        got = {r["doc_id"]: r["_items"] for r in decontaminate.find_contaminated(df, bench, **options).collect()}
        assert got == {1: ["i-3", "i-3"], 2: [None], 3: []}
    index = decontaminate.Index.build(items, Counter(w for _, t in items for w in set(decontaminate.terms_of(t))), 12, 26.0)
    own = [index.vocab[w] for w in decontaminate.terms_of(items[5][1])]
    import numpy as np

    score = sum(index.items.weights[index.items.starts[t] : index.items.starts[t + 1]][index.items.places[index.items.starts[t] : index.items.starts[t + 1]] == 5].sum() for t in sorted(set(own)))
    assert any(i == 5 for *_, i, _ in decontaminate.candidates([np.array(own)], index, float(score)))  # exactly at the threshold


def test_articles_of_many_layouts():
    rng = random.Random(33)
    good = bad = 0
    for _ in range(300):
        blocks = ["Title of it"] + [prose(rng, "en", rng.randrange(12, 60)).capitalize() + "." for _ in range(rng.randrange(1, 6))]
        inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{x}</p>" for x in blocks[1:])
        box = rng.choice(['<article class="post category-search">%s</article>', '<div class="entry related-topics">%s</div>', '<div class="single alert">%s</div>', '<main class="content no-sidebar">%s</main>', '<div class="hentry comment-status-open">%s</div>', '<div id="content"><div class="body">%s</div></div>', "<article><section>%s</section></article>", '<div class="modal-open content">%s</div>', "<td>%s</td>"])
        side = f'<div class="{rng.choice(["sidebar", "widget-area", "ad-slot", "cookie-notice"])}"><p>{prose(rng, "de", 25)}.</p></div>'
        comments = f'<div class="comments"><p>{prose(rng, "fr", 30)}.</p></div>' if rng.random() < 0.5 else ""
        page = f'<html><head><title>T</title></head><body><header><a href="/">Home</a></header><nav><a>One</a><a>Two</a></nav>{box % inner}{side}{comments}<footer>Foot</footer></body></html>'
        text = html_extract.extract(html_extract.parse(page), None)
        good, bad = good + (text == "\n".join(blocks)), bad + (text != "\n".join(blocks))
    assert good >= 0.97 * (good + bad), (good, bad)
    assert html_extract.extract(html_extract.parse('<article><p data-x="oops>One text</p><p>Two</p></article>'), None) == "One text\nTwo"


def test_pages_that_repeat_or_tie(spark):
    page = "<html><body><div class='%s'><p>Some text of the article, with words, and more of them.</p></div></body></html>"
    rows = [(1, "http://h.org", page % "a"), (1, "http://h.org", page % "a"), (2, "http://h.org", page % "b"), (3, "http://h.org", page % "b"), (4, "http://h.org", page % ("c" * 50_000))]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("_text", F.lit("mine")).withColumn("_host", F.lit("mine"))
    got = html_extract.html_extraction(df).collect()
    assert sorted(r["page_id"] for r in got) == [1, 1, 2, 3, 4] and {r["_text"] for r in got} == {"Some text of the article, with words, and more of them."} and {r["_host"] for r in got} == {"h.org"}


def test_pipeline_stages(spark, folder, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(4)
    text = prose(rng, "en", 80)
    rows = [(1, text), (5, text + " more"), (5, prose(rng, "de", 50)), (None, text), (None, text), (None, prose(rng, "fr", 50)), (None, ""), (7, None), (7, None), (8, "  ")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = C.one_of_each_group(spark, df, "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, text), rows[2], rows[5], (None, ""), (7, None), (8, "  ")])
    docs = spark.read.parquet(folder[0] + "/documents.parquet")
    strange = spark.createDataFrame([(900, "цбфщ ржйд хгкт " * 20, None, "s", 1), (901, "12", None, "s", 2)], docs.schema)
    left = {r["doc_id"] for r in C.known_language(spark, docs.unionByName(strange), "").collect()}
    assert set(range(150)) <= left and not left & {500, 501, 502, 900, 901}
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), folder[0]).count() == 0


def shuffled(spark, run):
    """Bytes that the stages of ``run`` write for shuffles."""
    jvm = spark.sparkContext._jvm
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    each = lambda: {(s := got.apply(k)).stageId(): s.shuffleWriteBytes() for got in [stages()] for k in range(got.size())}
    settle = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    settle()
    last = max(each(), default=-1)
    run()
    settle()
    return sum(n for k, n in each().items() if k > last)


def test_near_copies_leave_texts_where_they_are(spark, tmp_path, monkeypatch):
    import corpus_pipeline as C

    rng = random.Random(8)
    texts = [" ".join(rng.randbytes(100).hex() for _ in range(30)) for _ in range(400)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(1000 + k, texts[k] + " more", "en", "s", 1) for k in range(20)] + [(7, texts[7], "en", "r", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "in"))
    df, out = spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out")
    written = []
    monkeypatch.setattr(C, "staged", lambda df, tag, f=C.staged: (written.append(df.columns), f(df, tag))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables too large to broadcast
    try:
        moved = shuffled(spark, lambda: C.one_of_each_group(spark, df, "").write.parquet(out))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    kept = spark.read.parquet(out).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == list(enumerate(texts)) and all(r["source"] == ("r" if r["doc_id"] == 7 else "s") for r in kept)
    assert not any("text" in names for names in written) and 0 < moved < 0.3 * sum(map(len, texts)), (written, moved)


def test_rows_that_both_filters_hold_are_joined(spark):
    from limpid.llm.sketch import sifted

    df = spark.createDataFrame([(k % 3000, f"t{k}") for k in range(4000)], "k long, text string")
    known = df.groupBy("k").agg(F.count("*").alias("n")).withColumn("stays", F.col("k") % 2 == 0)
    for bits in (1 << 6, 1 << 20):
        assert sorted(tuple(r) for r in sifted(df, "k", known, bits).collect()) == [(k, min(f"t{k}", f"t{k + 3000}" if k < 1000 else f"t{k}")) for k in range(0, 3000, 2)]
