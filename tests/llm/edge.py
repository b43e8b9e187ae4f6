"""Edge rows and small inputs of the corpus tests."""

import random

SMALL = "/root/testdata/sf0.001"

_RNG = random.Random(4)
_WORDS = ["".join(_RNG.choice("abcdefgh") for _ in range(_RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(_WORDS) for _ in range(n))


def edge_rows():
    """(doc_id, text): nulls, empties, blanks, copies, near copies, long texts."""
    passage, long_text = prose(80, 1), prose(30_000, 2)
    near = passage.split()
    near[40] = "changed"
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One TWO"), (6, passage), (7, " ".join(near)),
        (8, passage), (8, passage), (8, prose(60, 3)), (None, passage), (None, None), (None, prose(50, 5)),
        (9, prose(20, 6) + "\n" + passage + "\t" + prose(25, 7)), (10, long_text), (11, long_text[:90_000] + " end"),
        (12, "Nd, " * 300), (13, "x" * 200_000 + " y"), (14, "é ñ 日本 " + passage.upper()),
        (15, "mail a.b@c.de and a.b@c.de, ip 1.2.3.4 300.1.1.1 phone +1 (212) 555-0100 card 4111111111111111"),
        (16, "odd space   <|endoftext|> it's 12 345  \n\n  x"), (17, prose(4, 9)), (18, prose(5, 9)),
    ]
