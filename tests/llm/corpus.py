"""Small corpora with copies, near copies, shared passages and odd rows."""

import random
import re

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Columns whose names operators might use themselves.
EXTRA = "id long, row long, w string, u int, part int, label int, __gone int, n_hit int, gram string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def row(k, text):
    return (k, text, "en", f"src{(k or 0) % 3}", None if text is None else len(text), 7, 7, "w", 1, 2, 3, 4, 5, "g")


def prose(rng, n):
    vocab = ["".join(rng.choices("abcdeéñ", k=rng.randint(2, 6))) for _ in range(300)]
    out = []
    while n > 0:
        k = min(rng.randint(3, 12), n)
        out.append(" ".join(rng.choices(vocab, k=k)).capitalize() + ".")
        n -= k
    return "\n".join(out)


def texts(seed=1, n=60):
    rng = random.Random(seed)
    passage = prose(rng, 70)
    made = []
    for k in range(n):
        kind = k % 6
        text = prose(rng, rng.randint(1, 120))
        if kind == 1 and made:
            text = rng.choice(made)
        elif kind == 2 and made:
            own = rng.choice(made).split(" ")
            own[rng.randrange(len(own))] = "changed"
            text = " ".join(own)
        elif kind == 3:
            text = f"{text}\n{passage}\n{prose(rng, 20)}"
        elif kind == 4:
            text = text + "aB" * rng.randint(0, 300)
        made.append(text)
    return made


def rows(seed=1, n=60):
    """Ordinary rows, then a null text, an empty one, white space, a very long one, repeated rows, rows without an id, and
    rows that share an id with another text."""
    made = [row(k, t) for k, t in enumerate(texts(seed, n))]
    long = prose(random.Random(9), 12_000)
    odd = [row(1_000, None), row(1_001, ""), row(1_002, " \n\t\n "), row(1_003, long), row(1_004, "x"), row(1_005, "éé 日本語 𝄞"), row(1_006, "one two three")]
    shared = [row(None, made[3][1]), row(None, "no id at all"), row(None, None), row(3, made[9][1]), row(9, "another text of nine"), row(1_003, long + " end")]
    return [*made, *odd, made[3], made[3], row(1_000, None), row(1_001, ""), *shared]


def order(k):
    """Ids in order, null first."""
    return k is not None, k or 0
