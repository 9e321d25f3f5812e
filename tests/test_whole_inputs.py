"""Registered queries without SQL use whole texts, on invented rows."""

from difflib import SequenceMatcher

from lexloom.functions import similarity as M
from lexloom.plans import registry

HEAD = "<div class='a' id=\"x\"><p>" + "sama algus " * 60


def test_similarity_of_whole_pages(spark, tmp_path):
    html = [HEAD + "õun ja pirn</p></div>", HEAD.replace("'a' id=\"x\"", "b hidden id=x").replace("<p>", "<P>") + "hoopis muu lõpp 123 " * 20 + "</p></div>"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.model: r for r in registry.QUERIES["similarity_table"](spark, str(tmp_path)).collect()}
    one, two = "sama algus " * 60 + "õun ja pirn", "sama algus " * 60 + ("hoopis muu lõpp 123 " * 20).strip()
    attrs = ["div", "@class=b", "@hidden=", "@id=x", "p"], ["div", "@class=a", "@id=x", "p"]
    assert (got["m0"].content_score, got["m0"].structure_attrs, got["m0"].structure_tags) == (1, 1, 1)
    assert got["m1"].content_score == round(SequenceMatcher(None, list(two), list(one)).ratio(), 6) < 1
    assert got["m1"].structure_tags == 1
    assert got["m1"].structure_attrs == round(SequenceMatcher(None, *attrs).ratio(), 6) < 1


def test_whole_lines_reach_alignment(spark, tmp_path):
    """The seventh row is left out of the model: it meets rows that agree with its first four words only."""
    heads = ["oma", "kass", "lill", "moos", "rebane", "bust", "bus", "busse"]
    lines = [f"{h} üks kaks kolm {h} {tail}" for h, tail in zip(heads, ["puu maa", "vesi", "tuli", "õhk", "lumi jää", "six seven eight nine", "alpha beta gamma delta", "red green blue"], strict=True)]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    truth = [x.encode("ascii", "ignore").decode().split() for x in lines]
    rest = [" ".join(x[1:]) for x in truth]
    model = [(h.replace("o", "c") if i % 3 == 0 else h, rest[i]) for i, h in enumerate(heads) if i != 6]

    def run(name):
        return {r[1]: r for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}

    def best(i):
        scores = []
        for j, (head, text) in enumerate(model):
            second, first, dist = M.plain_token_set_ratio(rest[i], text), M.plain_ratio(heads[i], head), abs(i - j)
            if second >= 30 and (heads[i] == head or first >= 30):
                scores.append((300.0 - dist if heads[i] == head else first + second - dist * 0.1, -dist, j))
        return max(scores)

    sets, parts = run("token_set_ratio"), run("partial_ratio")
    for i, (_, text) in enumerate(model):
        assert sets[i].ratio == M.plain_token_set_ratio(rest[i], text)
        assert parts[i].ratio == M.plain_partial_ratio(heads[i], text)
    for name in ("match_score", "align_sequential"):
        got = run(name)
        assert [got[i].llm_seq for i in range(8)] == [best(i)[2] for i in range(8)]
        assert [round(got[i].score, 6) for i in range(8)] == [round(best(i)[0], 6) for i in range(8)]
