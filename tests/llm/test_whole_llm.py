"""Cases in which operators once told less than the whole of their matches."""

from collections import Counter

import numpy as np

from tessaria.llm import decontaminate, html_text, licence, lm_score, quality


def brute(find, w):
    out = {}
    for label, size, tokens, need in find.rows:
        for k in range(0, len(w), size):
            n = len(set(tokens) & {int(x) for x in w[k : k + 2 * size]})
            if n >= need:
                out[label] = max(out.get(label, 0), n / len(tokens))
    return out


def test_licence_tells_every_label_that_meets_the_threshold():
    find = licence.Templates(licence.TEMPLATES, {})
    filler = " ".join(f"word{i}" for i in range(200))
    for between in (filler, ""):
        w = licence.word_codes(f"Licensed under CC BY-NC 3.0 {between} Licensed under CC BY-SA 4.0 {filler}")
        got = find.search(w)
        assert got == brute(find, w) and {"cc-by-nc", "cc-by-sa"} <= set(got)


def test_short_items_are_never_missed():
    rng = np.random.default_rng(5)
    text = [f"w{x}" for x in rng.integers(0, 10**6, 4000)]
    items = [" ".join(text[i : i + n]) for n in range(1, 9) for i in (*range(16), *rng.integers(0, 3990, 400))]
    index = decontaminate.ItemIndex(list(range(len(items))), items)
    assert {len(s) for s in index.sets} == {1, 2, 3, 4}
    found, missing = index.search([" ".join(text), "w-1 w-2 w-3 w-4 w-5 w-6"])
    assert sorted(found) == [(i, len(s)) for i, s in enumerate(index.sets)] and not missing


def test_html_articles_stay_whole(spark):
    """Copies of one article, a sentence that all articles have, and one on half of them: nothing of an article goes."""
    body = [f"<p>paragraph {i} of the article that is copied</p>" for i in range(3)]
    rows = [(f"http://copies.org/{i}", f"<body><i>{i}</i><article><h1>One</h1>{''.join(body)}<p>seen {i} times</p></article></body>") for i in range(40)]
    line = "<p>Sign-off line.</p>"
    rows += [(f"http://signed.org/{i}", f"<body><article><h1>Head {i}</h1><p>the text of article {i}</p>{line * (i % 2)}</article><p>{line}</p></body>") for i in range(40)]
    rows += [(f"http://few.org/{i}", f"<body><article><p>Body {i}.</p>{line}</article></body>") for i in range(3)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["url"]: r["text"].split("\n\n") for r in html_text.extract_pages(pages).collect()}
    copied = [x[3:-4] for x in body]
    for i in range(40):
        assert got[f"http://copies.org/{i}"] == ["One", *copied, f"seen {i} times"]
        assert got[f"http://signed.org/{i}"] == [f"Head {i}", f"the text of article {i}", *["Sign-off line."] * (i % 2)]
    assert all(got[f"http://few.org/{i}"] == [f"Body {i}.", "Sign-off line."] for i in range(3))


def test_html_wrapper_is_made_of_every_page_of_a_host(spark, monkeypatch):
    """The variable text that only one page in a hundred of a host shows is a slot of the wrapper, however its pages are dealt."""
    monkeypatch.setattr(html_text, "PART", 4, raising=False)
    rows = [(f"http://all.org/{i}", f"<!-- {i} --><body><div class=a><p>{'n' + str(i) if i % 100 == 7 else 'same'}</p></div><div class=b><p>{'word ' * (30 + i) if i % 100 == 7 else 'fixed'}</p></div></body>") for i in range(300)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows * 2)], "page_id long, url string, html string")
    made = [html_text.wrappers(pages.repartition(n)).collect() for n in (1, 7)]
    assert made[0] == made[1] and len(made[0]) == 1
    text = made[0][0]["wrapper"]
    assert text.count("null") == 2 and "same" not in text and "fixed" not in text
    got = {r["url"]: r["text"] for r in html_text.extract_pages(pages).collect()}
    assert all(got[u] == (" ".join(["word"] * (30 + i)) if i % 100 == 7 else "fixed") for i, (u, _) in enumerate(rows))


def test_html_states_align_like_their_pages():
    """Trees that went through their state give the region and the elements of the wrapper that is inferred at once."""
    pages = sorted(f"<body><main><h1>Head {i}</h1>{'<p>a text of more than a few words</p>' * (i % 3)}<ul><li>{i}</li></ul></main><div class=k{i}>x</div></body>" for i in range(9))
    held = None
    for p in pages:
        node = html_text.Node.restored(html_text.tree(html_text.blocks(p)).state())
        held = node if held is None else html_text.merge(held, node)

    def plain(row):
        return [row[0], row[1], row[2] is None if row[0] == "#" else [plain(r) for r in row[2]]]

    assert plain(html_text.finish(held, len(pages))) == plain(html_text.infer(pages))


def scripts(spark):
    """Texts of a language of 900 characters, some beyond 16 bits, and of one of few."""
    rng = np.random.default_rng(8)
    signs = [chr(0x4E00 + i) for i in range(880)] + [chr(0x20000 + i) for i in range(20)]
    rows = ["".join(signs[int(k)] for k in np.minimum(rng.zipf(1.3, 90) - 1, 899)) + " " + "ab " * 30 for _ in range(30)]
    rows = [(i, t, "zh") for i, t in enumerate(rows)] + [(50 + i, "plain words of few letters " * (2 + i), "en") for i in range(4)] + [(60, None, "zh"), (61, "", "zh")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_quality_counts_every_trigram_of_every_character(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_DOCS", 3)
    rows, docs = scripts(spark)
    got = [r["n"] for r in quality.count_ngrams(docs, quality.languages(docs)).collect()]
    want = Counter((lang, *g) for _, t, lang in rows for s in [["", "", *(t or "")]] for g in zip(s, s[1:], s[2:]))
    assert sorted(got) == sorted(want.values())


def test_quality_of_a_large_model_in_parts(spark, monkeypatch):
    """A model of more n-grams than are held at once gives the same scores and verdicts, by Spark's joins and a pass a part."""
    monkeypatch.setattr(quality, "LEAST_DOCS", 3)
    _, docs = scripts(spark)
    want, kept = sorted(quality.quality(docs).collect()), sorted(quality.quality_filter(docs).collect())
    monkeypatch.setattr(quality, "ENTRIES", 800)
    assert max(r[-1] for r in quality.train(docs)[2]) > 1
    got = quality.quality(docs).collect()
    assert sorted(got) == want and sorted(quality.quality_filter(docs).collect()) == kept


def test_kneser_ney_of_long_codes_sums_to_one():
    a = quality.Alphabet([97, 98])
    code, n = np.unique(a.codes("ab\u4e00\u4e8cab\U00020000\u4e00a\u4e00b\u4e8c\u4e00"), return_counts=True)
    m = quality.KneserNey(code, n)
    every = np.array([*range(quality.SYMBOLS), *(quality.SYMBOLS + x for x in (0x4E00, 0x4E8C, 0x20000))])
    for x, y in ((1, 2), (0, 0), (quality.SYMBOLS + 0x4E00, quality.SYMBOLS + 0x4E8C), (quality.SYMBOLS + 0x4E8C, 1)):
        wide = np.maximum(np.maximum(x, y), every) >= quality.SYMBOLS
        at = np.where(wide, quality.SHORT + (x << 42 | y << 21 | every), (x * 128 + y) * 128 + every)
        assert abs((10 ** m.log10(at)).sum() - 1) < 1e-9


def test_lm_tokens_score_like_plain_softmaxes(monkeypatch):
    """Tokens scored together, over blocks and short last groups, against one softmax after the other."""
    monkeypatch.setattr(lm_score, "BLOCK", 64)
    rng = np.random.default_rng(2)
    for size in (2, 9, 30, 131):
        m = lm_score.LogBilinear(rng.dirichlet(np.ones(size)))
        w, u, v = rng.integers(0, size, (3, 500))
        got = m.log_probs(w, u, v)
        for i in range(500):
            q, want = np.append(m.R[u[i]] @ m.C1 + m.R[v[i]] @ m.C2, 1), 0.0
            for x, _, width in m.levels:
                at = w[i] // width
                low = at // m.branch * m.branch if width < m.branch**2 else 0
                z = x[low : low + m.branch if width < m.branch**2 else len(x)] @ q
                want += z[at - low] - np.log(np.exp(z).sum())
            assert abs(got[i] - want) < 1e-4
    assert len(m.log_probs(*np.zeros((3, 0), np.int64))) == 0
