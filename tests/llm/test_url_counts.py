"""All labelled URLs but the held-out ones train; counts that are joined score as broadcast ones do."""

from collections import Counter

from fleetscope.llm import url_model as U
from fleetscope.llm.queries import URL_RULES, table

FOLDER = "/root/testdata/sf0.01"


def test_urls_beyond_the_sample_train(spark):
    urls = [f"http://{'ads' if i % 2 else 'good'}.org/p{i}" for i in range(200)]
    f = U.train(spark.createDataFrame([(u,) for u in urls], "url string"), sample=10)
    for model, start in ((f.accepted, "good"), (f.rejected, "ads.")):
        texts = [u[7:] for u in urls if u[7:].startswith(start)]
        seen = {g for t in texts for g in [(U.START * 4 + t + U.END)[i:i + 5] for i in range(len(t) + 1)]}
        known = Counter(g in model.log for g in seen)
        assert known[False] <= 40  # 10 of 100 are held out; four windows each may be theirs alone


def test_joined_counts_score_the_same(spark, monkeypatch):
    pages = table(spark, FOLDER, "pages").select("page_id", "url")
    odd = ["http://é.ORG/fr/ü", "http://never-seen.zz/QQ", "://net/", "", None, "http://a.net/#b", "http://never-seen.zz/QQ"]
    asked = pages.limit(200).unionByName(spark.createDataFrame([(-i, u) for i, u in enumerate(odd, 1)], "page_id long, url string"))
    small = U.train(pages, sample=50)
    monkeypatch.setattr(U, "BROADCAST_GRAMS", 0)
    large = U.train(pages, sample=50)
    assert isinstance(large, U.TableFilter) and abs(large.threshold - small.threshold) < 1e-9
    one, two = ({r["page_id"]: r for r in U.judge(asked, URL_RULES, f).collect()} for f in (small, large))
    assert len(one) == len(two) == 200 + len(odd)
    for k, r in one.items():
        assert abs(r["score"] - two[k]["score"]) < 1e-9 and r["verdict"] == two[k]["verdict"] and r["rule"] == two[k]["rule"]


def test_every_url_decides_the_threshold(spark, monkeypatch):
    """The threshold against a plain cross-fit over all URLs, which a sample of some of them misses."""
    urls = [f"http://{'ads' if i % 3 == 0 else 'good'}{'.x' if i % 7 else '-q'}.org/p{i * i % 89}/{i}" for i in range(300)]
    pages = spark.createDataFrame([(u,) for u in urls + urls[:5]], "url string")
    texts = {r.t: (r.bad, r.fold) for r in spark.createDataFrame([(u[7:],) for u in urls], "t string").selectExpr(
        "t", "split(t, '[^a-z0-9]+')[0] = 'ads' AS bad", "pmod(xxhash64(t), 2) AS fold").collect()}

    def model(bad, folds):
        return U.Model(Counter(g for t, (b, k) in texts.items() if b == bad and k in folds for s in [U.START * 4 + t + U.END]
                               for i in range(4, len(s)) for g in [s[i - n:i + 1] for n in range(5)]))

    by_fold = [U.Filter(model(False, [1 - k]), model(True, [1 - k]), 4) for k in (0, 1)]
    scores = sorted((round(by_fold[k].score(t), 9), b) for t, (b, k) in texts.items())
    good, bad = sum(not b for _, b in scores), sum(b for _, b in scores)
    cuts = [scores[0][0] - 1, *[(x + y) / 2 for (x, _), (y, _) in zip(scores, scores[1:]) if x < y], scores[-1][0] + .5]
    best = min((round(sum(not b for x, b in scores if x < c) / good + sum(b for x, b in scores if x > c) / bad, 12), c) for c in cuts)
    f = U.train(pages)
    assert abs(f.threshold - min(best[1], 0.0)) < 1e-9
    monkeypatch.setattr(U, "BROADCAST_GRAMS", 0)
    assert abs(U.train(pages).threshold - f.threshold) < 1e-8
