"""Large groups of near copies that aren't similar enough."""

import random

from pixelweft.llm import line_dedup


def test_pairs_of_a_crowd_are_not_made(spark, monkeypatch):
    """Of the pairs in a group of near copies just under the similarity the join makes few, and no link is lost."""
    r = random.Random(51)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    base = [word() for _ in range(240)]
    lines = []
    for _ in range(150):
        w = list(base)
        for i in r.sample(range(240), 11):
            w[i] = word()
        lines.append(" ".join(w))
    sets = [{s[i : i + 5] for i in range(len(s) - 4)} for s in lines]
    links = [(i, j) for j in range(len(lines)) for i in range(j) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    name = list(range(len(lines)))
    for _ in lines:
        for i, j in links:
            name[i] = name[j] = min(name[i], name[j])
    made = {}

    def counted(df, called, write=line_dedup.durable):
        out = write(df, called)
        made[called] = max(made.get(called, 0), out.count() if called == "open_pairs" else 0)
        return out

    monkeypatch.setattr(line_dedup, "durable", counted)
    found = line_dedup.line_components(spark.createDataFrame(list(enumerate(lines)), "lid long, line string"))
    got = {q["lid"]: q["component"] for q in found.collect()}
    assert got == {i: name[i] for i in {i for p in links for i in p}}
    assert made["open_pairs"] <= len(links) + len(lines)
