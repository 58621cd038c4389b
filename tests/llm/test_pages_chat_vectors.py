import random

import numpy as np

from stratafold.llm import ann, chat, html


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rnd = random.Random(0)
    for _ in range(300):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        assert html.shared(a, b).sum() == lcs(a, b)


def test_long_alignments_take_little_memory(monkeypatch):
    rnd = random.Random(1)
    monkeypatch.setattr(html, "CELLS", 16)
    for _ in range(200):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 20))] for _ in range(2))
        got = html.shared(a, b)
        common = [x for x, g in zip(a, got) if g]
        rest = iter(b)
        assert len(common) == lcs(a, b) and all(x in rest for x in common)
    monkeypatch.undo()
    a = np.arange(6000)
    b = np.random.default_rng(0).permutation(6000)
    assert 100 < html.shared(a, b).sum() < 200  # 36 million cells; about twice the root of the length


def test_page_reading():
    page = """<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a href="/">Home</a></ul></nav>
    <div class="cookie-banner">We use</div><article class="post"><h1>A &amp; B</h1><p><b>One
      two<br><p>Three <i>four</i><form><input value=">">Search</form><div class="comments"><p>Nice!</div><script>var x = "</p>";</script></article><footer>&copy; me</footer>"""
    lines, inside = html.page_lines(page)
    assert [x for x, i in zip(lines, inside) if i] == ["A & B", "One two", "Three four"]
    assert html.page_lines("<p>cut off <b") == (["cut off"], [html.OUTSIDE])
    assert html.page_lines(None) == ([], [])


def test_differencing(spark):
    site = lambda k: f"<body><div>Site name</div><div>Story {k} begins</div><div>and ends {k}</div><div>All rights</div></body>"
    rows = [(k, f"http://h.org/a/{k}", site(k)) for k in range(6)] + [(6, "http://h.org/a/5", site(5)), (7, None, site(7)), (8, "http://alone.org/x", site(8)), (9, "http://h.org/a/9", None), (2, "http://h.org/a/2", site(2))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html.extract(df).collect()]
    assert len(got) == 11
    for k in range(5):
        assert (k, f"Story {k} begins\nand ends {k}") in got
    assert (9, "") in got and (8, "Site name\nStory 8 begins\nand ends 8\nAll rights") in got
    assert html.extract(df.where("page_id < 0")).count() == 0


def brute_text(pages):
    """Texts by the definition: quadratic alignments of each page with the nearest ones of its host."""
    import re

    read = [(r["page_id"], r["url"], *html.url_parts(r["url"]), *html.page_lines(r["html"])) for r in pages]
    out = []
    for pid, url, host, path, lines, marks in read:
        if host:
            first = {}
            for p, _, h, q, ls, _ in read:
                if h == host and ls:
                    first[tuple(ls)] = min(first.get(tuple(ls), (q, p)), (q, p))
            order = sorted(first, key=first.get)
        else:
            order = []
        gone = None
        if tuple(lines) in order:
            at = order.index(tuple(lines))
            own = first[tuple(lines)][0]
            near = [(k, o) for k, o in enumerate(order) if 0 < abs(k - at) <= html.REACH]
            near.sort(key=lambda n: (-len(re.match(r"(.*).*\0\1", own + "\0" + first[n[1]][0], re.S)[1]), abs(n[0] - at), n[0] - at))
            for _, other in near:
                now = html.shared([hash(v) for v in lines], [hash(v) for v in other])
                assert now.sum() == lcs(lines, other)
                if now.all() or now.sum() == len(other) or not now.any():
                    continue
                gone, enough = (now, now.sum() <= html.MUCH * len(lines)) if gone is None else (gone & now, True)
                if enough:
                    break
        article = any(m != html.OUTSIDE for m in marks)
        keep = lambda k, m: m == html.INSIDE or ((m == html.DOUBTFUL or not article) and not (gone is not None and gone[k]))
        out.append((pid, "\n".join(v for k, (v, m) in enumerate(zip(lines, marks)) if keep(k, m))))
    return sorted(out)


def test_pages_without_article_tags_equal_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    plain = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    rows = []
    for r in pages.collect():
        h = r["html"].replace("<article", "<div").replace("</article", "</div").replace("<nav", "<div").replace("</nav", "</div").replace("<footer", "<p").replace("</footer", "</p")
        rows.append((r["page_id"], f"http://h{r['page_id'] % 3}.org/{r['page_id'] % 7}/{r['page_id']}", h.replace("</body>", "<div>All rights</div></body>")))
    rows += [(900 + k, f"http://h0.org/{k}/x", rows[0][2]) for k in range(6)]  # copies
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = brute_text([{"page_id": a, "url": b, "html": c} for a, b, c in rows])
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        assert sorted((r["page_id"], r["text"]) for r in html.extract(df).collect()) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum("All rights" in t for _, t in want) < len(want) / 20 and len(plain) == pages.count()


def test_doubtful_names_are_decided_by_the_neighbours(spark):
    def page(k):
        return f"""<body><article><h1>Title {k}</h1><section class="share-price-report"><p>Price of {k}</p></section>
        <div class="related-work"><p>Work {k}</p></div><div class="promo-teaser"><p>Buy our book</p></div><p>Same words</p>
        <div class="comment-list"><p>Nice {k}</p></div></article><div>site</div></body>"""

    df = spark.createDataFrame([(k, f"http://h.org/{k}", page(k)) for k in range(3)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got == {k: f"Title {k}\nPrice of {k}\nWork {k}\nSame words" for k in range(3)}


def test_pages_that_mark_their_article_are_compared_too(spark):
    def page(k):
        return f"<body><div>Site</div><article><h1>Title {k}</h1><p>Same words</p><p>Story {k}</p></article><div>Also on this site {k}</div><div>Rights</div></body>"

    df = spark.createDataFrame([(k, f"http://h.org/{k}", page(k)) for k in range(5)] + [(5, "http://h.org/4", page(4)), (6, None, page(6)), (7, "http://h.org/7", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert {k: r["text"] for k, r in got.items()} == {7: "", **{k: f"Title {min(k, 4) if k < 6 else k}\nSame words\nStory {min(k, 4) if k < 6 else k}" for k in range(7)}}
    assert [(r["n_deleted"], r["n_restored"]) for _, r in sorted(got.items())] == [(3, 1)] * 6 + [(0, 0)] * 2


def test_names_with_further_words_are_dropped():
    names = ["user-comments", "reader-comments", "comment-42", "ad-slot-728", "legal-notice", "cookie-warning", "newsletter-form", "promo-2024", "ad-300x250", "site_cookie_text"]
    for name in names:
        page = f'<body><article class="post has-comments" id="comments-open-7"><p>Real</p><div class="{name}"><p>Junk</p></div><p>text</p></article></body>'
        assert html.page_lines(page) == (["Real", "text"], [html.INSIDE] * 2), name
    for name in ["chapter-2", "p-17", "col-12", "figure-1", "commentary", "no-ads", "adventure", "post-comments-closed"]:
        page = f'<body class="cookie-consent-given"><article><p>Real</p><div class="{name}"><p>also</p></div></article></body>'
        lines, marks = html.page_lines(page)
        assert lines == ["Real", "also"] and html.OUTSIDE not in marks, name
    assert html.page_lines('<article class="promo-feature-2024 entry-content"><p>It is the article</p></article>')[0] == ["It is the article"]


def test_chat_round_trip(spark):
    bad = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", f"{bad} {'word ' * (k * 7)}end {k}") for k in range(1, 30)]
    rows += [(2, 0, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", "b"), (3, 5, None, "x:y"), (4, 0, "assistant", "long " * 900), (None, 0, "user", "nobody")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    w = chat.windows(df)
    assert w.where("n_tokens > 512").count() == 1  # the one turn that is longer than the budget
    back = chat.read_back(w).orderBy("conv_id", "window").collect()
    by = {}
    for r in back:
        by.setdefault(r["conv_id"], []).append(r)
    turns = [(t["role"], t["text"]) for r in by[1] for t in r["turns"]]
    assert turns == [(r[2], r[3]) for r in rows if r[0] == 1]
    assert [x for r in by[1] for x in r["learnt"]] == [r[3] for r in rows if r[0] == 1 and r[2] == "assistant"]
    assert [t["text"] for r in by[2] for t in r["turns"]] == ["", "", "b"] and by[3][0]["turns"][0]["text"] == "x:y"
    later = [r for r in w.where("conv_id = 1").collect() if r["window"] > 0]
    assert later and all(r["formatted"].startswith("### system: be kind</turn>\n") and r["n_context"] >= 1 for r in later)
    assert chat.windows(df.where("conv_id < 0")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([centres[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 16)), np.repeat(centres[:1], 600, axis=0) + 1e-3 * rng.normal(size=(600, 16))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(len(u)), -s))[:5]
        hit, total = hit + len(set(want.tolist()) & set(found.values())), total + 5
    assert set(got) == set(range(0, len(x), 50)) and hit / total >= 0.9
    few = df.where("vec_id in (0, 50, 51)")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 2
    assert ann.nearest(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


def test_nearest_of_very_large_and_small_vectors(spark, monkeypatch):
    """Squares of such components overflow or vanish; every finite, not zero vector takes part all the same."""
    from fractions import Fraction

    monkeypatch.setattr(ann, "LEAF", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    x[:5], x[5:10] = 1e-200, 1e200
    x[10] = [1e-300, 1, 2, 3]
    x[11] = [5e-324, 0, 0, 0]
    x[12] = [-1.7e308, 1.7e308, 0, 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = [[Fraction(c) for c in v] for v in x]
    norm = [sum(c * c for c in v) for v in exact]
    assert set(got) == set(range(40))
    for q, rows in got.items():
        cos = {}
        for i in range(40):
            if i != q:
                dot = sum(a * b for a, b in zip(exact[q], exact[i], strict=True))
                cos[i] = (1 if dot > 0 else -1) * float(dot * dot / norm[q] / norm[i]) ** 0.5
        want = sorted((-round(c, 12), i) for i, c in cos.items())[:3]
        assert [(-round(s, 12), i) for _, i, s in sorted(rows)] == want


def test_nearest_ties_and_repeated_rows(spark):
    rows = [(k, [1.0, 0.0]) for k in (3, 1, 2)] + [(50, [2.0, 0.0]), (50, [0.0, 1.0]), (7, [0.0, 3.0]), (7, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest(df, df.where("vec_id = 50"), 3).collect())
    assert got == sorted([(50, 1, 1, 1.0), (50, 2, 2, 1.0), (50, 3, 3, 1.0), (50, 1, 7, 1.0), (50, 2, 7, 1.0), (50, 3, 1, 0.0)])


def test_one_leaf_asked_by_many(spark, monkeypatch):
    monkeypatch.setattr(ann, "ASKED", 7)
    monkeypatch.setattr(ann, "PART", 9)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(df, df, 4).collect()}
    assert got == {(q, k + 1): int(v) for q in range(60) for k, v in enumerate(np.argsort(-s[q])[:4])}


def test_a_system_turn_beyond_the_budget(spark):
    rows = [(1, 0, "system", "rule " * 600)] + [(1, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(1, 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.windows(df)
    back = chat.read_back(w).orderBy("window").collect()
    assert [t["text"] for r in back for t in r["turns"]] == [r[3] for r in rows]
    assert [x for r in back for x in r["learnt"]] == [f"turn {k}" for k in (2, 4, 6)]
