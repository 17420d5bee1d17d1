"""The training-data operators against brute force, and on nulls, ties, repeats and empty tables."""

import base64
import gzip
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from limpid.llm import components, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, line_dedup, mixing, quality, secret_scan, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, suspect int, _tokens int"


def docs(spark, rows):
    """Rows (doc_id, text, source) with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2) for i, t, s in rows], SCHEMA).repartition(3)


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(k, words(rng, rng.randrange(1, 120)), f"s{k % 3}") for k in range(80)]
    base = words(rng, 100).split()
    for k in range(40):  # near copies of one text
        w = base[:]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(100)] = f"edit{rng.randrange(1000)}"
        rows.append((100 + k, " ".join(w), "s0"))
    rows += [(200 + k, "The Same text. Of many\nCOPIES here and there" if k % 2 else "the same Text. of many\ncopies here and there", "s1") for k in range(30)]
    rows += [(300, None, None), (301, "", "s1"), (302, " \t\n", "s1"), (None, "a row without id", "s1"), (None, None, None), (303, "one", "s2"), (304, "one", "s2"), (305, "repeat me", "s2"), (305, "repeat me", "s2"), (306, "word " * 30_000, "s2")]
    return rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("ranges", [1, 3])
def test_exact_dedup(spark, corpus, monkeypatch, ranges):
    assert exact_dedup.ranges_of(10, 1 << 15) == 1 and exact_dedup.ranges_of(4 * 10**10, 1 << 29) == 299
    monkeypatch.setattr(exact_dedup, "ranges_of", lambda rows, bits: ranges)
    groups = defaultdict(list)
    for i, t, _ in corpus:
        groups[norm(t)].append(i)
    out = exact_dedup.exact_dedup(docs(spark, corpus)).collect()
    assert len(out) == len(corpus) and sum(r["kept"] for r in out) == len(groups)
    best = lambda g: max((i for i in g if i is not None), default=None)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == Counter((i, best(groups[norm(t)]), len(groups[norm(t)])) for i, t, _ in corpus)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs(spark, corpus))
    assert kept.columns == docs(spark, corpus).columns and {norm(r["text"]) for r in kept.collect()} == set(groups) and kept.count() == len(groups)


def test_exact_dedup_is_native(spark, corpus):
    plan = exact_dedup.exact_dedup(docs(spark, corpus))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_token_counts(spark, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path("piece_bpe_32k.model"))
    rows = corpus + [(400, "<s> a </s>  b ▁ c  \n  d\x00 é ﬁ " * 50, "s")]
    got = token_counts.token_counts(docs(spark, rows), split_chars=64, batch_bytes=500, limit=100).collect()
    want = Counter((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t, _ in rows)
    assert Counter(tuple(r) for r in got) == want
    assert token_counts.token_counts(empty(spark)).count() == 0
    assert token_counts.token_counts(docs(spark, [(1, "hello world", "s")]), model="byte_bpe_50k.json").first()["n_tokens"] == 2


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_line_dedup(spark, broadcast):
    rng = random.Random(5)
    pool = [words(rng, 5) for _ in range(30)] + ["short", "é" * 19, "é" * 20]
    rows = [(k, "\n".join(rng.choice([" ", ""]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) for x in rng.choices(pool, k=rng.randrange(6))), "s") for k in range(60)]
    rows += [(100, None, None), (101, "", "s"), (None, pool[0] + "\n" + pool[1], "s"), (102, pool[0], "s"), (102, pool[0], "s")]
    keys = lambda t: [x.strip(b" \t\n\v\f\r") for x in norm(t).split(b"\n")]
    seen, keep = Counter(), {}
    for i, t, _ in rows:
        for k in {k for k in keys(t) if len(k.decode()) >= 20}:
            seen[k] += 1
            keep[k] = max(keep.get(k, -1), -1 if i is None else i)
    want = Counter()
    for i, t, _ in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t)) if seen[k] < 3 or keep[k] == i]
        want[i, "\n".join(kept), len(keys(t)), len(keys(t)) - len(kept)] += 1
    out = line_dedup.line_dedup(docs(spark, rows), broadcast_keys=broadcast)
    assert Counter((r["doc_id"], r["text"], r["_n_lines"], r["_n_dropped"]) for r in out.collect()) == want
    assert line_dedup.line_dedup(empty(spark), broadcast_keys=broadcast).count() == 0


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, corpus, size, percent):
    def grams(t):
        w = norm(t).split()
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = [grams(t) for _, t, _ in corpus]
    n = len(sets)
    near = [[j for j in range(n) if j != k and sets[k] and sets[j] and 100 * len(sets[k] & sets[j]) >= percent * len(sets[k] | sets[j])] for k in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[k], *(root[j] for j in near[k])]) for k in range(n)]
        if new == root:
            break
        root = new
    least = {}
    for k in range(n):
        if corpus[k][0] is not None:
            least[root[k]] = min(least.get(root[k], 1 << 60), corpus[k][0])
    want = Counter((corpus[k][0], len(sets[k]), least.get(root[k]), len(near[k])) for k in range(n))
    got = jaccard_join.jaccard_join(docs(spark, corpus), shingle=size, percent=percent).collect()
    assert Counter(tuple(r) for r in got) == want
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0


def test_group_bound_never_hides_a_link():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 60, 80).astype(np.uint64))
    members = []
    for k in range(40):
        s = base.copy()
        s[rng.integers(0, 80, rng.integers(0, 12))] = rng.integers(0, 1 << 60, 1).astype(np.uint64)
        members.append((bytes([k]), np.unique(s), 1))
    group = jaccard_join.Group(members)
    for key, s, _ in members:
        want = [k for k, m in enumerate(members) if m[0] != key and 100 * len(np.intersect1d(s, m[1])) >= 80 * len(np.union1d(s, m[1]))]
        assert group.links(key, s, 80).tolist() == want


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (102, 100), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100, 102: 100}


def test_secret_scan(spark):
    plain = "password=hunter22x"
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    for hidden in (b64(plain), b64(b64(plain)), b64(gzip.compress(plain.encode())), b64(zlib.compress(b64(plain).encode())), "%70assword%3Dhunter22x", "%2570assword=hunter22x", "\\u0070assword=hunter22x", b64("%70assword%3Dhunter22x")):
        text = f"é before {hidden} after"
        base, spans = secret_scan.find_secrets(text)
        assert (9, 0, 9 + len(hidden)) in spans or any(9 <= a and b <= 9 + len(hidden) for a, k, b in spans if k == 0), hidden
    assert secret_scan.scan("passwd: token: abcdef") == [] and secret_scan.scan("x secret = 'abc.def' AKIA" + "A" * 16 + " " + "0f" * 12) == [(2, 0, 19), (21, 1, 41), (42, 2, 66)]
    assert secret_scan.scan("\u017fecret=abcdefgh to\u212aen=abcdefgh") == []
    rows = [(1, f"a {plain}", "s"), (2, None, "s"), (3, "", "s"), (None, plain, "s"), (1, f"a {plain}", "s"), (4, "%41" * 20_000, "s"), (5, "x" * 100_000, "s")]
    got = secret_scan.secret_scan(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], len(r["base"])) for r in got) == Counter([(1, 1), (1, 1), (2, 0), (3, 0), (None, 1), (4, 0), (5, 0)])
    assert secret_scan.secret_scan(empty(spark)).count() == 0


def test_language_id(spark, sf=("fr le la les une avec pour dans", "en the and with from this that for", "de der die das und nicht mit ein")):
    rng = random.Random(2)
    vocab = {x.split()[0]: x.split()[1:] for x in sf}
    text = lambda k, n: " ".join(rng.choice(vocab[k]) + rng.choice(["", "ing" if k == "en" else "eux" if k == "fr" else "ung"]) for _ in range(n))
    model = language_id.train({k: [text(k, 40) for _ in range(20)] for k in vocab}, steps=30)
    rows = [(k, text(lang, 300), lang) for k, lang in enumerate(["fr", "en", "de"] * 5)] + [(90, None, None), (91, "", None), (92, "12 34 ½ _", None), (93, "the " * 5000, "en")]
    got = {r["doc_id"]: r for r in language_id.language_id(docs(spark, rows), model).collect()}
    assert all(got[i]["lang_pred"] == (lang or "und") for i, _, lang in rows) and all(0 <= r["score"] <= 1 for r in got.values())
    mixed = language_id.label_words(text("en", 10) + " " + text("de", 10), model)
    assert sum(lang == "en" for _, lang in mixed[:10]) >= 9 and sum(lang == "de" for _, lang in mixed[10:]) >= 9
    assert language_id.language_id(empty(spark), model).count() == 0
    assert language_id.fit(empty(spark)).langs == ["und"]


def test_forward_backward_is_exact():
    import itertools

    rng = np.random.default_rng(0)
    scores, trans = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    want = np.zeros((6, 3))
    for y in itertools.product(range(3), repeat=6):
        w = np.exp(scores[range(6), y].sum() + sum(trans[a, b] for a, b in zip(y, y[1:]))) * np.exp(trans)[:, y[0]].sum()
        want[range(6), y] += w
    assert np.allclose(language_id.marginals(scores, np.array([6]), trans)[0], want / want.sum(1, keepdims=True))
    long = rng.normal(size=(300, 3))
    a = np.exp(trans)
    e = np.exp(long)
    f, b = [np.ones(3) / 3], [np.ones(3)]
    for t in range(300):
        x = (f[-1] @ a) * e[t]
        f.append(x / x.sum())
    for t in range(299, 0, -1):
        x = a @ (e[t] * b[-1])
        b.append(x / x.sum())
    want = np.array(f[1:]) * np.array(b[::-1])
    assert np.allclose(language_id.marginals(long, np.array([0, 300, 0]), trans)[0], want / want.sum(1, keepdims=True))


def test_secrets_beside_escapes():
    esc = lambda x: "".join(f"\\u{ord(c):04x}" for c in x)
    url = lambda x: "".join(f"%{ord(c):02x}" for c in x)
    for hidden in (f'"password": "{esc("hunter22")}', f'"token":"{url("abcdef")}', f"password: {url('hunter22')}", "\\u0070assword: hunter22", f"{esc('password')} = {url('hunter22')}", f"password: {url(url('hunter22'))}", f"%70assword: \u00e9 {esc('secret')}: %C3%A9 AKIA%41{'B' * 16}"):
        text = f"é 100% {hidden} after \\ %zz"
        key = hidden.index("AKIA") if "AKIA" in hidden else hidden.startswith('"')
        assert (7 + key, int("AKIA" in hidden), 7 + len(hidden)) in secret_scan.find_secrets(text)[1], hidden


def test_secrets_deep_in_compressed_layers():
    plain, pad = b"password=hunter22x", "\u00e9 \u20ac ".encode() * 4000
    deep = plain
    for _ in range(100):
        deep = gzip.compress(deep)
    two = gzip.compress(b"a first member, ") + gzip.compress(plain)
    for raw in (gzip.compress(pad + plain), gzip.compress(pad + plain + pad), zlib.compress(gzip.compress(pad + plain)), two, gzip.compress(gzip.compress(pad) + gzip.compress(b" " + plain)), deep):
        hidden = base64.b64encode(raw).decode()
        for most in (1 << 24, 1000, 1001, 1002, 1003):
            assert (9, 0, 9 + len(hidden)) in secret_scan.find_secrets(f"\u00e9 before {hidden} after", most)[1], (len(raw), most)
    big = base64.b64encode(zlib.compress("\u20ac".encode() * (6 << 20) + b" " + plain)).decode()
    assert secret_scan.find_secrets(big)[1] == [(0, 0, len(big))]
    parts = list(secret_scan.unpacked(zlib.compress(bytes(range(256)) * 41), 1000))
    assert parts[0] + b"".join(p[500:] for p in parts[1:]) == bytes(range(256)) * 41


def test_secrets_in_base64_anywhere():
    plain = "password=hunter22x"
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    zipped = b64(gzip.compress(random.Random(1).randbytes(90).hex().upper().encode() + b" " + plain.encode()))
    wrap = lambda x, end: end.join(x[k : k + 64] for k in range(0, len(x), 64))
    whole = [b64(plain.encode(code)) for code in ("utf-16", "utf-16-le", "utf-16-be")] + [b64(b"\xff\x00\x01 " + plain.encode() + b"\xfe"), b64(b64(plain.encode("utf-16-le"))), b64(gzip.compress(plain.encode("utf-16-le")))]
    whole += [wrap(zipped, "\n"), wrap(zipped, "\r\n  "), wrap(zipped, "\\n"), wrap(b64("a" * 40 + " " + plain), "\n")]
    for before, hidden in [(b, h) for b in ("io/login/", "key-", "ab_c/", "/", " ") for h in (b64(plain), b64(plain).rstrip("="), zipped)] + [("é ", h) for h in whole]:
        spans = secret_scan.find_secrets(f"{before}{hidden} after")[1]
        assert (len(before), 0, len(before) + len(hidden)) in spans, (before, hidden)
    glued = "io/login/" + b64(plain) + "A"
    assert (9, 0, len(glued)) in secret_scan.find_secrets(glued)[1]


def test_quality(spark):
    rng = random.Random(4)
    make = {0: lambda: words(rng, 40) + " moron idiot", 1: lambda: " ".join(w.upper() + "!!" for w in words(rng, 40).split()), 2: lambda: words(rng, 40)}
    texts = [(make[g](), float(g)) for g in (0, 1, 2) for _ in range(150)]
    model = quality.train([t for t, _ in texts], [g for _, g in texts])
    assert np.all(np.diff(model.thresholds) > 0)
    rows = [(10 * g + k, make[g](), "s") for g in (0, 1, 2) for k in range(10)] + [(90, None, "s"), (None, "", "s")]
    got = quality.score_quality(docs(spark, rows), model).collect()
    tail = {r["doc_id"]: r["tail_probability"] for r in got}
    means = [np.mean([tail[10 * g + k] for k in range(10)]) for g in (0, 1, 2)]
    assert len(got) == len(rows) and means[2] > 2 * max(means[:2]), means
    assert quality.score_quality(empty(spark), model).count() == 0 and quality.train([], []).score("x") == (0.0, 1.0)


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(k, words(rng, 30) + ". " + words(rng, 6) + ".") for k in range(90)] + [(90, None), (91, ""), (92, "one")]
    rows = [(k, words(rng, 300), "s") for k in range(40)]
    rows += [(100 + k, f"{words(rng, 70 + 13 * k)} {items[k][1]} {words(rng, 50)}", "s") for k in range(20)] + [(200, None, "s"), (201, "", "s"), (None, items[3][1], "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard in (4096, 25):
        got = decontaminate.find_contaminated(docs(spark, rows), bench, shard_items=shard).collect()
        assert Counter((r["doc_id"], tuple(r["_items"])) for r in got) == Counter([(k, ()) for k in range(40)] + [(100 + k, (k,)) for k in range(20)] + [(200, ()), (201, ()), (None, (3,))])
    assert decontaminate.find_contaminated(empty(spark), bench).count() == 0
    assert all(r["_items"] == [] for r in decontaminate.find_contaminated(docs(spark, rows), bench.limit(0)).collect())


def test_items_with_symbols_lie_whole_in_a_window():
    rng = random.Random(9)
    own = words(rng, 80).split()
    item = " = ".join(own[:70]) + "? " + " | - | ".join(own[70:])
    index = decontaminate.Index.build([(0, item)], Counter(set(decontaminate.terms_of(item))), 1, 80.0)
    more = own[:]
    for k in (70, 50, 30, 10):
        more.insert(k, "inserted")
    for text in (item, " - ".join(own), " ".join(more)):
        for before in range(0, 260, 3):
            found = decontaminate.matches([f"{words(rng, before)} {text} {words(rng, 150)}"], index, 0.5, 5, 0.5, 0.5)
            assert list(found[0]) == [0], before


def test_bounds_lose_no_item():
    rng = random.Random(8)
    rows = [(k, words(rng, 20)) for k in range(100)]
    df = Counter(w for _, t in rows for w in set(decontaminate.terms_of(t)))
    index = decontaminate.Index.build(rows, df, 100, 20.0)
    texts = [words(rng, 150) + " " + rows[k][1] for k in range(20)]
    numbers = [np.array([index.vocab.get(w, -1) for w in decontaminate.terms_of(t)]) for t in texts]
    got = {(d, w, i) for d, w, i, _ in decontaminate.candidates(numbers, index, 0.3)}
    step, want = index.window // 2, set()
    for d, x in enumerate(numbers):
        for w in range(max(1, -(-len(x) // step))):
            terms = {t for t in x[w * step : w * step + 2 * step] if t >= 0}
            score = np.zeros(100)
            for t in terms:
                a, b = index.items.starts[t], index.items.starts[t + 1]
                score[index.items.places[a:b]] += index.items.weights[a:b]
            want |= {(d, w, int(i)) for i in np.flatnonzero(score >= 0.3)}
    assert got == want and got


def test_mixing(spark, corpus):
    out = mixing.mix_sources(docs(spark, corpus), entropy=1.0, repetitions=None, bucket_docs=8, block_tokens=500).collect()
    count = lambda t: len(norm(t).split())
    total, size = sum(count(t) for _, t, _ in corpus), Counter()
    for _, t, s in corpus:
        size[s] += count(t)
    live = [s for s in size if size[s]]
    drawn = Counter()
    for r in out:
        drawn[r["source"]] += r["_tokens"]
    for s in live:  # uniform weights; a stream overshoots by less than one document
        longest = max(count(t) for _, t, x in corpus if x == s)
        assert total / len(live) - 1e-6 <= drawn[s] < total / len(live) + longest
    assert all(r["_tokens"] > 0 for r in out)
    again = mixing.mix_sources(docs(spark, corpus), entropy=1.0, repetitions=None, bucket_docs=8, block_tokens=500).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.mix_sources(empty(spark)).count() == 0
    sizes = spark.createDataFrame([("a", 900, 1), ("b", 90, 1), ("c", 10, 1)], "source string, tokens long, docs long")
    at = mixing.bisect_exponent(sizes, 1000, repetitions=4.0)
    assert abs(mixing.measure(sizes, 1000, 1000, [at])[0][1] - 4.0) < 1e-3
    at = mixing.bisect_exponent(sizes, 1000, entropy=0.8)
    assert abs(mixing.measure(sizes, 1000, 1000, [at])[0][0] - 0.8 * np.log(3)) < 1e-3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a>Menu</a></li></ul></nav>
<div class="ad">Buy now, it is cheap, really cheap.</div><div class="wrap7"><div class="post">%s</div><div class="sidebar">Other, things, to read, here and there</div>
<div id="comments"><p>I like this, a lot, and more, and more words than the article itself has to offer to anyone.</p></div></div><form>Mail<input></form><footer>&copy; me</footer><script>var a="<p>no</p>"</script></body>"""


def test_html(spark):
    article = "<h1>A &amp; B</h1><p>First  <b>bold</b>\n text,<br>more of it, yes.<p>Second &eacute;t&eacute;, &lt;tag&gt;, and so on.<ul><li>one</li><li>two</li></ul>"
    want = "A & B\nFirst bold text, more of it, yes.\nSecond été, <tag>, and so on.\none\ntwo"
    rows = [(k, f"http://www.Host.org:80/{k}", PAGE % article) for k in range(4)] + [(10, "http://host.org/short", PAGE % "<p>x</p>"), (11, None, None), (12, "nonsense", ""), (13, "http://other.net", "plain text"), (14, "http://host.org/cut", (PAGE % article)[:430])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["_text"] for r in html_extract.html_extraction(pages).collect()}
    assert [got[k] for k in range(4)] == [want] * 4
    assert got[10] == "x" and got[11] == got[12] == "" and got[14].startswith("A & B\nFirst bold")
    assert html_extract.html_extraction(pages.limit(0)).count() == 0


def test_html_sections(spark):
    body = "Long text of the body, with many words, " * 9
    pages = {
        1: f"<article><h1>T</h1><div class=lead><p>The lead.</p></div><div class=body><p>{body}</p></div></article><div><p>{'Teaser, below. ' * 9}</p></div>",
        2: f"<div class=page><div class=title><h1>T</h1></div><div class=lead><p>The lead.</p></div><div class=body><p>{body}</p></div></div><div class=x><a>Link</a></div>",
        3: f"<main><div class=title><h1>T</h1></div><section><p>The lead.</p></section><section class=b><div><div><p>{body}</p></div></div></section></main>",
    }
    rows = [(10 * h + k, f"http://h{h}.org/{k}", f"<body>{p}</body>") for h, p in pages.items() for k in range(3)]
    rows += [(90 + k, "http://h2.org/bare", f"<body><div class=page><div class=body><p>{body}</p></div></div></body>") for k in range(5)]
    got = {r["page_id"]: r["_text"] for r in html_extract.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, text in got.items():
        assert text == (f"T\nThe lead.\n{body.strip()}" if k < 90 else body.strip()), k


def test_html_names_of_layout():
    p = "<p>Some text of the article, with words, and more of them.</p>"
    text = lambda html: html_extract.extract(html_extract.parse(f"<html><body>{html}</body></html>"), None)
    want = p[3:-4]
    for box in (
        '<main class="content no-sidebar">%s</main>', '<div class="has-sidebar">%s</div>', '<article class="post has-comments">%s</article>', '<article class="comments">%s</article>',
        '<div class="content-sidebar-wrap">%s</div>', '<div class="elementor-widget elementor-widget-text-editor">%s</div>', '<div class="page sidebar">%s</div>', '<div class="widget"><div class="x menu">%s</div></div>',
    ):
        nav = '<div class="menu"><a href=/>A link</a> <a href=/b>Another</a></div>'
        assert text(nav + box % p + "<footer>Foot, of the page</footer>") == want, box
    for name in ("sidebar", "post-comments", "ad-slot", "widget-area", "comment-list", "site-footer", "breadcrumbs", "related-posts", "ad", "cookie-notice", "main-nav", "share-buttons"):
        assert text(f'<div class="wrap"><div class="post">{p}</div><div class="{name}"><p>Some other text, of no article, that is long enough to stand.</p></div></div>') == want, name


def test_html_unclosed_and_shown_tags():
    text = lambda html: html_extract.extract(html_extract.parse(f"<html><body>{html}</body></html>"), None)
    p = "<p>Some text of the article, with words.</p>"
    want = p[3:-4]
    for before in ("<button>Menu", "<div><select><option>A</div>", "<select><option>A", "<div><template><p>No</p></div>", "<div><noscript>No</div>", "<svg><path>", "<button>Menu <button>More</button>", "<button><div>Menu</div></button>", "<template><template><p>No</p></template><p>No</p></template>"):
        assert text(f"{before}<article>{p}</article>") == want, before
    assert text(f"<article>{p}<p>An <button>Share</button> end <svg><text>no</text></svg>here<select><option>A</select>.</p></article><button>More") == f"{want}\nAn end here."
    shown = "<p>With <math><mi>x</mi>=<mn>1</mn></math>, <object>a picture</object> and <xmp><b> &amp;</xmp>.</p>"
    assert text(f"<article>{p}{shown}</article>") == f"{want}\nWith x=1, a picture and <b> &amp;."
    for tag in ("script", "style", "textarea", "title"):
        assert text(f"<article>{p}<{tag}>no</article><p>no</p>") == want


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    given = spark.read.parquet(f"{sf}/documents.parquet")
    assert set(given.columns) <= set(out.columns) and 0 < out.select("doc_id").distinct().count() <= given.count()
    d = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == given.columns, name
