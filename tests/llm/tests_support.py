"""Documents that several tests use."""

import random


def toxic_docs():
    """(doc_id, text, toxic): invented words, every third document with one of three insults."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice(["ba", "lo", "ri", "te", "su", "mo", "na"]) for _ in range(rnd.randint(1, 4)))
    insults = ["vilgrak", "dumskop", "zorfling"]
    out = []
    for k in range(700):
        w = [word() for _ in range(30)]
        y = k % 3 == 0
        if y:
            w[rnd.randrange(30)] = rnd.choice(insults)
        out.append((k, " ".join(w), int(y)))
    return out
