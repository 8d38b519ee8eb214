"""Quotes link to the latest whole original, else to the message that holds most of the passage."""

import random

from rowproof.llm import quotes


def test_repeated_sentences_and_messages(spark):
    rng = random.Random(5)
    pool = [f"Stock phrase number {i}." for i in range(7)]
    own = {(c, t): rng.sample(pool, rng.randrange(1, 4)) + ([f"Own {c} {t}."] if rng.random() < 0.3 else []) for c, n in (("a", 150), ("b", 12)) for t in range(n)}
    own |= {("r", 0): ["Yes.", "Thanks.", "A."], ("r", 1): ["Yes.", "Thanks.", "B."], ("r", 2): ["C."], ("s", 0): ["X."], ("s", 1): ["Y."], ("s", 2): ["X."], ("s", 3): ["D."]}
    quoted = {("r", 2): own["r", 1], ("s", 3): ["X."]}
    for (c, t) in own:
        if c in "ab" and t:
            quoted[c, t] = own[c, rng.randrange(t)] if rng.random() < 0.5 else [*rng.sample(pool, 2), "Said by nobody."]
    want = {}
    for (c, t), q in quoted.items():
        earlier = [(len(set(q) & set(own[c, s])), s) for s in range(t)]
        whole = [s for s in range(t) if set(own[c, s]) == set(q)]
        hits, source = max(earlier)
        want[c, t] = whole[-1] if whole else source if hits else None
    rows = [(c, t, "user", "\n".join([*(["> " + " ".join(quoted[c, t])] if (c, t) in quoted else []), " ".join(x)])) for (c, t), x in own.items()]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    lines = df.select("conv_id", "turn", quotes.parsed(df["text"]).alias("lines"))
    _, replies = quotes.reply_links(lines)
    got = {(r.conv_id, r.turn): r.reply_to for r in replies.collect()}
    assert got["r", 2] == 1 and got["s", 3] == 2
    assert got == {k: v for k, v in want.items() if v is not None}
