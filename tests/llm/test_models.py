import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gradus.llm import language_model, toxicity
from gradus.llm.language_model import Network, lm_scores
from gradus.llm.url_filter import judge_urls, split_url


def test_gradient_of_the_network():
    chance = np.random.default_rng(0)
    network = Network.start(chance.random(131) * 100 + 1, 8)
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    tokens = chance.integers(0, 131, (7, 3))
    tokens[3, 1] = 0
    start, h = {k: v.copy() for k, v in network.w.items()}, np.zeros((3, 8))

    def likelihood():
        states, _, _ = network.forward(tokens, h)
        return network.log_likelihood(states.reshape(-1, 8), tokens.reshape(-1))[0].sum()

    def slope(name, at):
        start[name][at] += 1e-3
        up = likelihood()
        start[name][at] -= 2e-3
        down = likelihood()
        start[name][at] += 1e-3
        return (up - down) / 2e-3

    memory = {k: np.zeros(v.shape) for k, v in network.memory().items()}
    network.learn(tokens, h, memory)
    network.w = start
    for name in ("back", "input", "bias"):
        for flat in np.argsort(-memory[name].ravel())[:3]:
            at = np.unravel_index(flat, start[name].shape)
            assert abs(abs(slope(name, at)) - math.sqrt(memory[name][at] * tokens.size)) < 1e-3
    for name in ("embed", "classes", "groups", "words"):  # a number a row: the mean square of its gradient
        for row in np.argsort(-memory[name])[:3]:
            own = [slope(name, (row, d)) for d in range(start[name].shape[1])]
            assert abs(np.mean(np.square(own)) - memory[name][row] * tokens.size) < 1e-3


def test_states_are_carried_across_windows(monkeypatch):
    chance = np.random.default_rng(1)
    network = Network.start(chance.random(131) * 100 + 1, 8)
    lengths = np.array([5, 90, 1, 33, 64])
    tokens = chance.integers(1, 131, lengths.sum())
    tokens[np.cumsum(lengths) - 1] = 0
    whole = language_model.score(network, tokens, lengths)
    for window, lanes in ((1, 1), (7, 2), (200, 5)):
        monkeypatch.setattr(language_model, "WINDOW", window)
        monkeypatch.setattr(language_model, "LANES", lanes)
        assert np.allclose(language_model.score(network, tokens, lengths), whole, atol=1e-4)
    classes = np.arange(network.words + 1)
    states = np.tile(chance.normal(size=8).astype(np.float32), (len(classes), 1))
    assert abs(np.exp(network.log_likelihood(states, classes)[0]).sum() - 1) < 1e-4  # a distribution


def test_language_model_counts(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 500)  # most words meet their counts in the join
    docs = odd_docs.collect()
    rows = lm_scores(odd_docs, keep=["doc_id"], share=1).collect()
    tokens = [[*(r.text or "").encode().lower().split(), b""] for r in docs]
    held = [zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2 for r in docs]
    counts = Counter(w for own, out in zip(tokens, held) if not out for w in own)
    n, v = sum(counts.values()), len(counts)
    want = sorted((out, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6)) for own, out in zip(tokens, held))
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lm_scores(no_docs).count() == 0


def test_network_learns_every_training_row_once(llm, monkeypatch):
    rows = [(k, "one hot text" if k % 3 == 0 else f"word{k} here and there") for k in range(600)]
    learnt, averaged = [], language_model._averaged

    def counted(weights, network):
        learnt.append(weights.agg(F.sum("n")).first()[0])
        return averaged(weights, network)

    monkeypatch.setattr(language_model, "_averaged", counted)
    total = lm_scores(llm.createDataFrame(rows, "doc_id long, text string")).first().train_tokens
    assert sum(learnt) == total
    assert all(abs(n - total / len(learnt)) < 0.1 * total for n in learnt)  # copies of a text are spread over the rounds


def test_the_commonest_words_are_found_by_their_counts(llm):
    chance = np.random.default_rng(3)
    rows = [(int(k), int(c)) for k, c in zip(chance.permutation(5000), np.minimum(chance.zipf(1.6, 5000), 10**6))]
    counts = llm.createDataFrame(rows, "key long, c long").repartition(7)
    for most in (1, 50, 1234, 5000, 9000):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:most]
        assert [tuple(r) for r in language_model._commonest(counts, most).collect()] == want
    assert language_model._commonest(counts.limit(0), 5).count() == 0


def test_kernel_tolerates_gaps_and_inserted_characters():
    values = toxicity.kernel(["loser", "l.o.s.e.r", "lxoser", "weather", ""], ["loser"])[:, 0]
    assert values[0] > 0.999 and values[1] > 0.999 and 0.5 < values[2] < 1 and values[3] < 0.1 and values[4] == 0


def test_toxicity_learns_held_out_labels(llm, odd_docs, no_docs):
    chance = np.random.default_rng(3)
    vocabulary = ["".join(chance.choice(list("aeiounrst"), 6)) for _ in range(400)]
    rows, labels = [], []
    for k in range(600):
        own = list(chance.choice(vocabulary, 40))
        toxic = k % 4 == 0
        if toxic:
            for bad in chance.choice(["wretchkin", "grobblefool", "wr.etch.kin", "w r e t c h k i n", "grobblefxool"], 2):
                own.insert(int(chance.integers(40)), str(bad))
        rows.append((k, " ".join(own)))
        labels.append((k, int(toxic)))
    docs, marks = llm.createDataFrame(rows, "doc_id long, text string"), llm.createDataFrame(labels, "doc_id long, toxic int")
    made = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    right = [made[k].predicted == int(k % 4 == 0) for k in held]
    assert np.mean(right) > 0.95
    odd = toxicity.toxicity(odd_docs, marks.limit(0), keep=["doc_id", "score"]).collect()  # nothing to learn from
    assert [r.score for r in odd] == [0.0] * 9 and odd_docs.count() == 9
    assert toxicity.toxicity(no_docs, marks).count() == 0


def test_every_window_of_a_long_word_is_learnt():
    """A word without spaces is read window by window in training as in scoring: its clean start stays clean."""
    word = "a" * 20 + "bcdefghijklm" * 6 + "wretchkin" + "zyxwvut" * 4
    parts = toxicity.windowed(word)
    assert parts[0] == word[:24] and any("wretchkin" in p for p in parts) and all(len(p) <= 24 for p in parts)
    assert toxicity.windowed("short-word!") == ["short-word!"] and toxicity.windowed("1-" * 40) == ["1-" * 40]
    window, _, _, of = toxicity.features([word])
    assert len(of) == len(parts)
    made = toxicity.margins(parts, *toxicity.fit({"wretchkin": 5.0}, {word[:24]: 3.0, "morning": 2.0}))
    assert made[0] < 0 < max(made)


def test_toxic_parts_of_long_words_are_found(llm):
    chance = np.random.default_rng(9)
    filler = lambda n: "".join(chance.choice(list("abcdefghijklmnopqrstuv"), n))
    rows = []
    for k in range(600):  # the insult stands alone in some texts, in the middle of a long word in others
        toxic = int(k % 2 == 0)
        word = "wretchkin" if toxic else filler(9)
        text = f"{filler(6)} {word} {filler(8)}" if k % 4 < 2 else filler(120) + word + filler(120) + " " + filler(7)
        rows.append((k, text, toxic))
    docs = llm.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = llm.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    made = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    held = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    for kind in (lambda k: k % 4 < 2, lambda k: k % 4 >= 2):
        assert np.mean([made[k] == y for k, y in held if kind(k)]) > 0.9


def test_worst_words_of_long_texts():
    weight, bias = toxicity.fit({"wretchkin": 5.0}, {"weather": 1.0, "morning": 1.0})
    own = toxicity.Scorer(weight, bias)
    margins, words = own.worst(["", None, "good morning wretchkin", "w r e t c h k i n", "morning " * 20000 + "wretchkin", "a" * 100 + "wretchkin" + "a" * 100], 1)
    assert margins[0, 0] == margins[1, 0] == bias
    assert words[2][0][0] == words[3][0][0] == words[4][0][0] == "wretchkin"
    assert margins[2, 0] == margins[3, 0] == margins[4, 0] > 0.5 and margins[5, 0] > margins[0, 0]


def test_urls(llm):
    urls = [
        (1, "http://A.Example.COM/en/x?q=1"), (2, "https://www.example.com/en/1#top"), (3, "http://b.net/es/1"), (4, "http://b.net/de/1"), (5, None), (6, "no scheme/path"),
        (7, "ftp://x.com"), (8, "http://x.com?y"), (9, ""), (9, ""), (None, "http://notexample.com/en/"), (11, "http://h.org/a/b/c/d/e/f/g/h/i"), (12, "http://b.NET/fr/"),
    ]
    pages = llm.createDataFrame([(k, u, "x") for k, u in urls], "page_id long, url string, host string")
    none = llm.createDataFrame([], "page_id long, good int")
    rows = {(r.page_id, r.path): r for r in judge_urls(pages, none, keep=["page_id", "host"]).collect()}
    rule = {k: (r.host, r.path, r.rule, r.verdict) for (k, _), r in rows.items()}
    assert rule[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert rule[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert rule[3][2:] == ("net/es/", "block") and rule[4][2] is None and rule[12][2:] == ("net/fr/", "block")
    assert rule[5][:3] == rule[6][:3] == rule[9][:3] == ("", "", None)
    assert rule[7][:3] == ("x.com", "", None) and rule[8][:3] == ("x.com", "", None)
    assert rule[None] == ("notexample.com", "/en/", "com/", "allow")
    assert judge_urls(pages, none).count() == len(urls) and judge_urls(pages.limit(0), none).count() == 0
    assert split_url(F.col("url"))


def test_templates_are_learnt_and_rejected(llm):
    rows = [(k, f"http://shop.org/{'spam' if k % 2 else 'news'}/{k}") for k in range(400)]
    pages = llm.createDataFrame(rows, "page_id long, url string")
    labels = llm.createDataFrame([(k, 0 if k % 2 else 1) for k in range(200)], "page_id long, good int")
    made = {r.page_id: r for r in judge_urls(pages, labels).collect()}
    assert made[399].template == "shop.org/spam/*" and made[399].verdict == "block"
    assert made[398].template == "shop.org/news/*" and made[398].verdict == "allow"
    same = llm.createDataFrame([(k, k % 4 // 2) for k in range(200)], "page_id long, good int")
    assert {r.template for r in judge_urls(pages, same).collect()} == {"shop.org/~/*"}


def test_paths_of_any_depth_are_read_where_rows_share_them(llm):
    """Beyond the sixth segment too, labels tell branches apart; a path that few share ends in **."""
    rows = [(k, f"http://h.org/a/b/c/d/e/f/g/{'bad' if k % 2 else 'good'}/{k}", 1 - k % 2) for k in range(300)]
    rows += [(1000, "http://h.org/a/b/c/d/e/f/other/x/y/z", None), (1001, "http://few.org/" + "/".join(map(str, range(500))), None)]
    pages = llm.createDataFrame(rows, "page_id long, url string, good int")
    made = {r.page_id: (r.template, r.verdict) for r in judge_urls(pages.select("page_id", "url"), pages.select("page_id", "good")).collect()}
    top = "h.org" + 6 * "/~"
    assert made[0] == (f"{top}/~/good/*", "allow") and made[1] == (f"{top}/~/bad/*", "block")
    assert made[1000][0] == f"{top}/~/~/**" and made[1001][0] == "few.org/**"


def test_repeated_and_odd_labels_of_pages(llm):
    pages = llm.createDataFrame([(k, f"http://h.org/x/{k}") for k in range(60)] + [(0, "http://h.org/x/0")], "page_id long, url string")
    labels = llm.createDataFrame([(k, 1) for k in range(60)] + [(k, 0) for k in range(60)] + [(3, None), (4, 7), (999, 1), (None, 1)], "page_id long, good int")
    rows = judge_urls(pages, labels).collect()
    assert len(rows) == 61 and {(r.template, r.verdict) for r in rows} == {("h.org/~/*", "block")}  # the smallest label holds


def test_frequent_segments_of_a_variable_level_keep_their_names(llm):
    for spam in (1000, 3000):  # a third and three fifths of the rows
        rows = [(k, f"http://h.org/spam/{k}", 0) for k in range(spam)]
        rows += [(spam + k, f"http://h.org/slug{k}", 1) for k in range(2000)]
        rows += [(spam + 2000 + k, f"http://h.org/rare/{k}", 1 - spam // 3000) for k in range(18)]  # few rows, unlike most
        rows += [(spam + 2018 + k, f"http://h.org/twice/{k}", 0) for k in range(2)]
        pages = llm.createDataFrame(rows, "page_id long, url string, good int")
        made = {r.page_id: r for r in judge_urls(pages.select("page_id", "url"), pages.select("page_id", "good")).collect()}
        got = lambda low, high: {(made[k].template, made[k].verdict) for k in range(low, high)}
        assert got(0, spam) == {("h.org/spam/*", "block")}
        assert got(spam, spam + 2000) == {("h.org/*", "allow")}
        assert {t.split("/")[1] for t, _ in got(spam + 2000, spam + 2018)} == {"rare"}
        assert {t.split("/")[1] for t, _ in got(spam + 2018, spam + 2020)} == {"*"}


def test_network_tells_rare_words_of_the_head_by_context():
    counts = np.sort(np.random.default_rng(4).integers(2, 60, 9000))[::-1]
    own = language_model.Vocabulary(np.arange(1, 9001, dtype=np.uint64), counts, 500, int(counts.sum()) + 500, 9001)
    numbers = np.arange(9001)
    assert own.words == 9001 and (language_model._for_network(own, numbers) == numbers).all()  # none is one of the rest
    network = Network.start(own.frequencies(), 8)
    words, groups = network.cuts
    assert words[0] == groups[0] == 0 and words[-1] == 9001 and groups[-1] == len(words) - 1
    assert (np.diff(words) > 0).all() and (np.diff(groups) > 0).all() and len(words) > 50
    assert 9001**0.5 / 2 < len(words) < 2 * 9001**0.5
    pairs = np.tile(np.array([5000, 7000, 6000, 8000, 0]), 2000)  # 7000 follows 5000, and 8000 follows 6000
    for _ in range(60):  # a pass is one step
        language_model.train(network, pairs, np.full(2000, 5))
    made = language_model.score(network, np.array([5000, 7000, 0, 5000, 8000, 0]), np.array([3, 3]))
    assert made[1] > made[4] + 1
    states = np.full((9002, 8), 0.3, np.float32)
    assert abs(np.exp(network.log_likelihood(states, np.arange(9002))[0].astype(np.float64)).sum() - 1) < 1e-3
