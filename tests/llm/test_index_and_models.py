"""Vector index, classifiers and graph scores against brute force, held-out labels and odd rows."""

import math
import zlib

import numpy as np
import pytest

from daypanel.llm import components, language, near_vectors, queries, toxicity, url_filter

FOLDER = "/root/testdata/sf0.1"


def linked_pairs(rows, least=0.93):
    out = []
    for i, (_, x, a) in enumerate(rows):
        for j, (_, y, b) in enumerate(rows[:i]):
            if a is None or a != b or not x or not y or len(x) != len(y):
                continue
            if any(v is None or not math.isfinite(v) for v in [*x, *y]) or not any(x) or not any(y):
                continue
            x_, y_ = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
            if x_ @ y_ / math.sqrt((x_ @ x_) * (y_ @ y_)) >= least:
                out.append((i, j))
    return out


def expected(rows):
    root, links = [r[0] for r in rows], [0] * len(rows)
    for i, j in linked_pairs(rows):
        links[i] += 1
        links[j] += 1
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted((r[0], n, c, r[0] == c) for r, n, c in zip(rows, links, root))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, n int, cell string").repartition(4)


def test_extreme_components_keep_their_direction(spark):
    rows = [(1, [1e-200, 2e-200], 1), (2, [1e-200, 2e-200 * 1.01], 1), (3, [1e200, 2e200], 1), (4, [2.0, -1.0], 1), (5, [5e-324, 1e-323], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.linked(table).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "MEMBERS", 16)  # so that cells come in several chunks
    monkeypatch.setattr(near_vectors, "VISITORS", 16)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):
        base = rng.standard_normal(12)
        for j in range(6):
            v = base + rng.standard_normal(12) * 0.05 * j
            rows.append((len(rows), v.tolist(), k % 3))
    rows += [(300 + k, rows[0][1], 0) for k in range(40)]  # many equal vectors
    rows += [(400, (2 * np.array(rows[0][1])).tolist(), 0), (401, rows[0][1], 1), (402, rows[0][1], None)]
    rows += [(410, None, 0), (411, [], 0), (412, [0.0] * 12, 0), (413, [float("nan")] * 12, 0), (414, [float("inf"), *[1.0] * 11], 0)]
    rows += [(415, [None, *rows[0][1][1:]], 0), (416, rows[0][1][:11], 0), (417, [*rows[0][1], 0.0], 0)]
    got = sorted(map(tuple, near_vectors.linked(vectors(spark, rows)).collect()))
    assert got == expected(rows)
    assert max(r[1] for r in got) > 40
    assert near_vectors.linked(vectors(spark, [])).count() == 0
    bad = near_vectors.linked(vectors(spark, rows[-8:-3])).collect()
    assert all(r.n_links == 0 and r.kept for r in bad)


def test_recall_on_the_table(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    want = ((x @ x.T >= 0.93) & (label[:, None] == label[None, :])).sum(1) - 1
    got = {r.vec_id: r.n_links for r in queries.QUERIES["op1_multi_index_vectors"](spark, FOLDER).collect()}
    assert [got[r[0]] for r in rows] == want.tolist()


def test_components(spark):
    rng = np.random.default_rng(8)
    chain = [(k, k + 1) for k in range(100, 180)]
    star = [(500, k) for k in range(501, 560)]
    loose = [tuple(map(int, p)) for p in rng.integers(1000, 1060, (45, 2))]
    edges = chain + star + loose + [(7, 7)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}
    for a, b in edges * 200:
        root[a] = root[b] = min(root[a], root[b])
    want = {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_kernel(a, b):
    """Gap-weighted common subsequences of three letters, one by one."""
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), toxicity.ORDER):
        for j in combinations(range(len(b)), toxicity.ORDER):
            if all(a[p] == b[q] for p, q in zip(i, j)):
                total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_equals_the_plain_one():
    units = ["abcabc", "xabyc", "ññab", "zzz", "abc", "a1b2c3"]
    marks = ["abc", "abab", "zzzz", "ñab"]
    got = toxicity.kernel(units, marks)
    for u, row in zip(units, got):
        for m, v in zip(marks, row):
            want = plain_kernel(u, m) / math.sqrt(plain_kernel(u, u) * plain_kernel(m, m))
            assert v == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_units():
    assert toxicity.sentence_units("you i.d.i.o.t and an i d i o t") == {"you", "idiot", "and"}
    assert toxicity.sentences(None) == [""]


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    pos = label == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def test_toxicity_on_held_out_labels(spark):
    got = queries.QUERIES["op2_string_kernel_toxicity"](spark, FOLDER).toPandas().set_index("doc_id")
    label = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas().set_index("doc_id").toxic
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert len(got) == docs and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    test = got[got.held_out].join(label, how="inner")
    assert len(test) > 300
    # One in twenty toxic labels of this table stands on a text without any insult, so 0.95 is about the most.
    assert auc(test.score.to_numpy(), test.toxic.to_numpy()) > 0.88
    assert (test.predicted == test.toxic).mean() > 0.94


def toy_texts():
    clean = [f"the quiet river number{k} runs by the old mill. it is a calm day" for k in range(60)]
    bad = [f"the quiet river number{k} runs. you are a blockhead{k % 4} indeed. such a nitwit today" for k in range(60)]
    return clean + bad, [0] * 60 + [1] * 60


def test_sample_is_drawn_among_texts_that_fit(spark, monkeypatch):
    """Nine of ten labelled texts are too long to train on; the draw is filled from the others."""
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 20)
    seen = []
    monkeypatch.setattr(toxicity, "fitted", lambda texts, toxic, share: seen.append((texts, toxic, share)))
    long = "z " * toxicity.TRAIN_BYTES
    docs = spark.createDataFrame([(k, f"text {k}" if k % 10 == 0 else long) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k // 10 % 2) for k in range(400)] + [(None, 1)], "doc_id long, toxic int")
    toxicity.trained(docs, labels)
    (texts, toxic, share), = seen
    fits = [k for k in range(0, 400, 10) if zlib.crc32(str(k).encode()) % 5]
    assert sorted(texts) == sorted(f"text {k}" for k in fits) and sum(toxic) == sum(k // 10 % 2 for k in fits)
    assert share == pytest.approx(0.5, abs=0.1)


def test_changed_insults_are_found():
    model = toxicity.fitted(*toy_texts(), 0.5)
    score = lambda *t: model.probability(toxicity.Scorer(model).documents(list(t)))
    p = score("the quiet river. you are a n.i.t.w.i.t indeed. such a n i t w i t today",
              "the quiet river. you are a nitxwit indeed. such a blockqhead1 today", "the old mill. a calm river", "")
    assert p[0] > 0.5 and p[1] > 0.5 and p[2] < 0.5 and p[3] < 0.5


def test_toxicity_of_odd_rows(spark):
    texts, toxic = toy_texts()
    schema = "doc_id long, text string, score string, toxic string"
    docs = spark.createDataFrame([(k, t, "s", "t") for k, t in enumerate(texts)] + [(1000, None, "s", "t"), (1001, "", "s", "t"), (None, "x", "s", "t"),
                                 (1002, "z" * 200_000 + " nitwit", "s", "t"), (1002, "z" * 200_000 + " nitwit", "s", "t")], schema)
    labels = spark.createDataFrame([(k, y) for k, y in enumerate(toxic)] + [(0, 0), (5000, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels).toPandas()
    assert len(got) == len(texts) + 5 and got.score.notna().all()
    assert (got[got.doc_id < 60].predicted == 0).all() and (got[got.doc_id.between(60, 119)].predicted == 1).all()
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 60 <= kept.count() <= 65
    one_class = toxicity.scored(docs, labels.filter("toxic = 0"))
    assert one_class.filter("score < 0.5").count() == len(texts) + 5
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    assert toxicity.scored(docs, labels.limit(0)).filter("predicted = 0").count() == len(texts) + 5


def rank(edges, seeds, rounds, back):
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    out = {h: {} for h in hosts}
    for a, b, w in edges:
        x, y = (b, a) if back else (a, b)
        out[x][y] = out[x].get(y, 0) + w
    r = dict(seeds)
    for _ in range(rounds):
        new = {h: (1 - url_filter.DAMPING) * s for h, s in seeds.items()}
        for h, v in r.items():
            flows = out[h] or {h: 1.0}
            for to, w in flows.items():
                new[to] = new.get(to, 0) + url_filter.DAMPING * v * w / sum(flows.values())
        r = new
    return r


def test_ranks_equal_the_plain_ones(spark):
    rng = np.random.default_rng(3)
    edges = [(f"h{a}", f"h{b}", float(w)) for a, b, w in rng.integers(1, 12, (40, 3)) if a != b]
    merged = {}
    for a, b, w in edges:
        merged[a, b] = merged.get((a, b), 0) + w
    edges = [(a, b, w) for (a, b), w in merged.items()]
    trust, bad = {"h1": 0.75, "h2": 0.25}, {"h9": 0.5, "lonely": 0.5}
    seeds = [("trust", h, s) for h, s in trust.items()] + [("distrust", h, s) for h, s in bad.items()]
    got = url_filter.propagated(spark.createDataFrame(edges, "src string, dst string, weight double"),
                                spark.createDataFrame(seeds, "kind string, host string, share double"))
    got = {(r.kind, r.host): r["rank"] for r in got.collect()}
    want = {("trust", h): v for h, v in rank(edges, trust, url_filter.ROUNDS, False).items()}
    want |= {("distrust", h): v for h, v in rank(edges, bad, url_filter.ROUNDS, True).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def rule_of(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in url_filter.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_rules_and_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/7x?a=/en/", "http://a.b.example.com/en/8#x", "x://com/en/", "x://notcom/en/",
            "http://example.net/de/8/1", "http://example.net/de/9", "ftp://sub.org/es/://y", "http://sub.org/es", "http://ÀB.org\n/es/", "http://h.net?x/de/"]
    urls += [f"http://h{k}.net/de/{k}" for k in range(20)] + ["http://h1.net/fr/"] * 3
    html = "<a href='http://h1.net/x'>a</a> <a href=\"//Far.ORG/y\"> <a href=/local>"
    rows = [(k, u, None if k % 5 == 0 else html, "r", "v") for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string, verdict string").repartition(3)
    got = {r.page_id: r for r in url_filter.judged(pages).collect()}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        host, path, (rule, verdict) = rule_of(url)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), url
        assert got[k].verdict == verdict if rule else got[k].verdict in ("allow", "block")
    assert got[0].verdict == "allow"
    assert got[len(urls) - 1].verdict == "allow"  # a trusted host's other pages
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_far_hosts_of_a_large_corpus_are_judged(spark):
    """A chain of 24 hosts up to one blocked page, crowded at its start, beside many blocked pages elsewhere."""
    link = lambda host: f"<a href='http://{host}/'>"
    rows = [("http://bad.com/en/1", None)] + [(f"http://c{k}.zz/", link(f"c{k - 1}.zz" if k else "bad.com")) for k in range(24)]
    rows += [(f"http://s{j}.{k}x.zz/", link(f"c{k}.zz")) for k in range(4) for j in range(30)]
    rows += [("http://far.zz/", None)]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    crowd = spark.range(1000, 21000).selectExpr("id as page_id", "'http://bulk.org/es/1' as url", "cast(null as string) as html")
    for corpus in (pages, pages.union(crowd)):
        got = {r.host: (r.verdict, r.trust_share) for r in url_filter.judged(corpus).filter("page_id < 1000").collect()}
        assert {h for h, (v, _) in got.items() if v == "allow"} == {"far.zz"}
        assert all(share == 0 for h, (_, share) in got.items() if h != "far.zz")


def test_strangers_share_no_parent(spark):
    """Addresses, ports and the caller's suffixes vouch for nobody; a registered domain does."""
    hosts = ["bad0.co.uk", "innocent.co.uk", "bad1.co.uk", "10.0.0.1", "77.9.0.1", "a.x.zz:8080", "b.x.zz:8080", "www.shop.zz", "m.shop.zz", "[::1]"]
    pages = spark.createDataFrame([(k, f"http://{h}/p", None) for k, h in enumerate(hosts)], "page_id long, url string, html string")
    rules = [("bad0.co.uk/", "block"), ("10.0.0.1/", "block"), ("a.x.zz:8080/", "block"), ("www.shop.zz/", "block")]
    got = {r.host: r.verdict for r in url_filter.judged(pages, rules, suffixes=["co.uk"]).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"bad0.co.uk", "10.0.0.1", "a.x.zz:8080", "www.shop.zz", "m.shop.zz"}


def test_verdicts_equal_the_plain_ones(spark):
    """Every page of a small table: rules, ranks on the written-out host graph, shares and verdicts."""
    draw = np.random.default_rng(11)
    names = [f"{s}.{d}{k}.{t}" for k, t in enumerate(("com", "net", "org", "com", "net", "org")) for d in "ab" for s in ("www", "m")]
    paths = ["/en/7", "/en/1", "/de/8", "/de/1", "/es/1", "/fr/1", "/fr/2"]
    rows = []
    for k in range(150):
        links = "".join(f"<a href='http://{names[j]}/'>" for j in draw.integers(0, len(names), draw.integers(0, 3)))
        rows.append((k, f"http://{names[draw.integers(len(names))]}{paths[draw.integers(len(paths))]}", links))
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    ruled = {k: rule_of(url) for k, url, _ in rows}
    seeds, links, known = {"allow": {}, "block": {}}, {}, set()
    for k, _, html in rows:
        host, _, (rule, verdict) = ruled[k]
        known.add(host)
        if rule:
            seeds[verdict][host] = seeds[verdict].get(host, 0) + 1
        for to in html.split("http://")[1:]:
            to = to.split("/")[0]
            if to != host:
                links[host, to] = links.get((host, to), 0) + 1
                known.add(to)
    weight = {e: math.log1p(n) for e, n in links.items()}
    for host in known:
        parent = host.split(".", 1)[1]
        for e in ((host, parent), (parent, host)):
            weight[e] = weight.get(e, 0) + 1.0
    edges = [(a, b, w) for (a, b), w in weight.items()]
    ranks = [rank(edges, {h: n / sum(s.values()) for h, n in s.items()}, 200, back) for s, back in ((seeds["allow"], False), (seeds["block"], True))]
    unclear = 0
    for k, (host, path, (rule, verdict)) in ruled.items():
        trust, distrust = (r.get(host, 0.0) for r in ranks)
        share = trust / (trust + distrust) if trust + distrust else 1.0
        assert got[k].trust_share == pytest.approx(share, abs=1e-3)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        if rule or abs(share - 0.5) > 1e-3:
            assert got[k].verdict == (verdict or ("block" if share < 0.5 else "allow"))
        else:
            unclear += 1
    assert unclear < 15


def test_deep_domains_are_linked_to_the_end(spark):
    host = ".".join(["a"] * 126 + ["zz"])
    got = url_filter.host_edges(spark.createDataFrame([(host, None)], "host string, html string")).collect()
    assert len(got) == 2 * 125


def test_links_become_host_edges(spark):
    pages = spark.createDataFrame([("a.x.com", "<a href='https://B.org/1'><img src=//a.x.com/i><a href=//b.org>"), ("b.org", None), ("", "href=//z.com")],
                                  "host string, html string")
    got = {(r.src, r.dst): r.weight for r in url_filter.host_edges(pages).collect()}
    assert got == {("a.x.com", "b.org"): pytest.approx(math.log1p(2)), ("a.x.com", "x.com"): 1.0, ("x.com", "a.x.com"): 1.0}


def test_language_of_documents(spark):
    """Text evidence alone on documents that the trigram table did not see."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    seen = docs.filter("doc_id % 2 = 0")
    table = language.trigram_table(seen.select("text", "lang"), {k: v // 2 for k, v in sorted(names.items())})
    evidence = language.text_evidence(table)
    got = docs.filter("doc_id % 2 = 1").select("lang", evidence("text").alias("e")).collect()
    right = [sorted(names)[int(np.argmax(r.e))] == r.lang for r in got]
    assert np.mean(right) > 0.95


def test_declared_languages_agree(spark):
    got = queries.QUERIES["op9_fused_language"](spark, FOLDER).toPandas()
    assert len(got) == 2500
    assert (got.lang == got.declared).mean() > 0.97
    assert got.probability.between(0, 1.0000001).all()


def test_language_evidence_is_fused(spark):
    en, de = "the house and the river with the old mill ", "das haus und der fluss mit der alten muehle "
    docs = spark.createDataFrame([(k, en * 3, "en") for k in range(20)] + [(k, de * 3, "de") for k in range(20, 40)] + [(50, None, "fr"), (51, "x", None)],
                                 "doc_id long, text string, lang string")
    page = lambda k, host, text, lang: (k, f"http://{host}/p", f"<html lang='{lang}'><p>{text}</p><script>the the</script></html>", "x", "y")
    rows = [page(k, "a.de", de, "de") for k in range(30)] + [page(100 + k, "b.com", en, "en") for k in range(30)]
    rows += [page(200, "a.de", "", "de"), page(201, "b.com", "", "en"), page(202, "a.de", "", ""), (203, None, None, "x", "y"), page(100, "b.com", en, "en")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lang string, host string")
    got = {r.page_id: r for r in language.identified(pages, docs).collect()}
    assert language.identified(pages, docs).count() == len(rows)
    assert all(got[k].lang == "de" for k in range(30)) and all(got[100 + k].lang == "en" for k in range(30))
    assert got[200].lang == "de" and got[201].lang == "en" and got[202].lang == "de"  # host and suffix decide without text
    assert got[203].host == "" and got[203].declared == ""
    assert language.identified(pages.limit(0), docs).count() == 0
    assert {r.lang for r in language.identified(pages, docs.limit(0)).collect()} == {""}


def test_copies_do_not_tip_the_trigram_table(spark):
    """A language whose rows are copies of one text keeps it; a text of most rows counts once."""
    en, de = "the house and the river with the old mill", "das haus und der fluss mit der alten muehle"
    docs = spark.createDataFrame([(k, en, "en") for k in range(3000)] + [(5000 + k, f"{de} {k}", "de") for k in range(20)] + [(9000, None, "en")],
                                 "doc_id long, text string, lang string")
    once = spark.createDataFrame([(1, en, "en")] + [(5000 + k, f"{de} {k}", "de") for k in range(20)], "doc_id long, text string, lang string")
    table = language.trigram_table(docs.filter("text is not null"), {"de": 20, "en": 1})
    assert np.array_equal(table, language.trigram_table(once, {"de": 20, "en": 1}))
    pages = spark.createDataFrame([(1, "http://a.x/", f"<p>{en}</p>"), (2, "http://b.x/", f"<p>{de}</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.text_lang for r in language.identified(pages, docs).collect()} == {1: "en", 2: "de"}


def test_addresses_have_no_domain_above(spark):
    read = spark.createDataFrame([("10.0.0.1", [1.0, 0.0])] * 9 + [("77.9.0.1", [0.0, 1.0])], "host string, p array<double>")
    got = {r.host: list(r.above) for r in language.host_priors(read, ["l", "m"]).collect()}
    assert got["77.9.0.1"] == got["10.0.0.1"] == pytest.approx([9.5 / 11, 1.5 / 11])


def test_priors_follow_the_domain_tree(spark):
    """Host sums smoothed by the domains above, written out."""
    rows = [("x.a.org", [1.0, 0.0])] * 4 + [("y.a.org", [0.0, 1.0])] * 2 + [("b.org", [0.0, 1.0])]
    read = spark.createDataFrame(rows, "host string, p array<double>")
    got = {r.host: r for r in language.host_priors(read, ["l", "m"]).collect()}
    k = language.PRIOR_PAGES
    base = np.array([4 + language.SMOOTHING, 3 + language.SMOOTHING]) / (7 + 2 * language.SMOOTHING)
    org = (np.array([4, 3]) + k * base) / (7 + k)
    a = (np.array([4, 2]) + k * org) / (6 + k)
    assert np.allclose(got["x.a.org"].above, a) and list(got["x.a.org"].own) == [4, 0] and got["x.a.org"].n == 4
    assert np.allclose(got["b.org"].above, org)
