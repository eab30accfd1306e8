"""URL templates of six levels and hot addresses against a plain version; training rows bounded by their features."""

import random
from collections import Counter, defaultdict

from oficina.llm import toxicity, url_filter

RULES = [("block", "bad.org/a/"), ("allow", "bad.org/b/"), ("block", "hot.net/x/y/")]


def plain(urls, rules):
    """(host, path) -> (template, verdict), a path at a time."""
    def cut_up(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:end].lower(), rest[end:]
        return host, tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]

    def rule(host, path):
        fits = [(len(t), t, w) for w, t in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        return max(fits)[2] if fits else None

    pages = Counter(map(cut_up, urls))
    segs = {k: [s for s in k[1].split("/") if s] for k in pages}
    at = {k: ("", "") for k in pages}
    for d in range(max(map(len, segs.values()))):
        kids = defaultdict(Counter)
        for k, n in pages.items():
            if len(segs[k]) > d:
                kids[k[0], at[k][0]][segs[k][d]] += n
        wild = {node: len(c) > url_filter.CHILDREN or sum(c.values()) < 2 * len(c) for node, c in kids.items()}
        at = {k: (t + "/" + ("*" if wild[k[0], t] else segs[k][d]), t) if len(segs[k]) > d else (t, p) for k, (t, p) in at.items()}
    m, b = Counter(), Counter()
    for k, n in pages.items():
        key = (k[0], at[k][1], at[k][0])
        m[key] += n if rule(*k) else 0
        b[key] += n if rule(*k) == "block" else 0
    prior = (sum(b.values()) + 1.0) / (sum(m.values()) + 2.0)
    group = lambda key, of: sum(of[x] for x in m if x[:2] == key[:2])

    def alike(x):
        mm, bb = group(x, m), group(x, b)
        apart = b[x] * (mm - m[x]) - (bb - b[x]) * m[x]
        return m[x] == 0 or bb * (mm - bb) == 0 or apart * apart * mm < url_filter.ALIKE * (m[x] * (mm - m[x]) * (bb * (mm - bb)))

    merged, verdict, w = {x: alike(x) for x in m}, {}, url_filter.WEIGHT
    for x in m:
        same = [y for y in m if y[:2] == x[:2] and merged[y]] if merged[x] else [x]
        host = (sum(b[y] for y in b if y[0] == x[0]) + w * prior) / (sum(m[y] for y in m if y[0] == x[0]) + w)
        verdict[x] = "block" if (sum(b[y] for y in same) + w * host) / (sum(m[y] for y in same) + w) >= 0.5 else "allow"
    return cut_up, {k: (at[k][0], rule(*k) or verdict[k[0], at[k][1], at[k][0]]) for k in pages}


def test_six_levels_and_hot_addresses_equal_the_plain_version(spark, monkeypatch):
    rng = random.Random(8)
    urls = ["http://hot.net/x/" + "/".join(rng.choice("yzw") + (str(rng.randrange(30)) if rng.random() < 0.4 else "") for _ in range(rng.randrange(1, 5))) + rng.choice(["", "/end"]) for _ in range(300)]
    urls += [f"https://{rng.choice(['bad.org', 'a.bad.org', 'c.com'])}/{rng.choice('abc')}/{rng.randrange(5)}/q/{rng.randrange(3)}" for _ in range(200)]
    # A third of all rows have no address, many have one.
    urls += [None] * 150 + ["no address"] * 100 + ["http://hot.net/?q"] * 120
    monkeypatch.setattr(url_filter, "HOT_NODES", 20)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    cut_up, want = plain(urls, RULES)
    got = url_filter.judge(df, ["page_id"], "url", RULES).collect()
    assert max(p.count("/") for _, p in want) >= 6
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    assert {r.page_id: (r.host, r.path, r.template, r.verdict) for r in got} == {i: (*cut_up(u), *want[cut_up(u)]) for i, u in enumerate(urls)}


def test_training_rows_are_bounded_by_features(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["good", "kind", "word"]) + str(rng.randrange(40)) for _ in range(60)) + (" vile scum" if i % 4 == 0 else "")) for i in range(400)]
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    whole = toxicity.train(texts, labels, "doc_id", "text", "toxic", toxicity.ToxicityParams(bits=16))
    same = toxicity.train(texts, labels, "doc_id", "text", "toxic", toxicity.ToxicityParams(bits=16, train_features=10**6))
    part = toxicity.train(texts, labels, "doc_id", "text", "toxic", toxicity.ToxicityParams(bits=16, train_features=30_000))
    assert (whole.weights == same.weights).all() and whole.bias == same.bias
    assert (part.weights != whole.weights).any()
    score = {r.doc_id: r.score for r in toxicity.predict(texts, part, "text", ["doc_id"]).collect()}
    assert min(s for i, s in score.items() if i % 4 == 0) > max(s for i, s in score.items() if i % 4)
