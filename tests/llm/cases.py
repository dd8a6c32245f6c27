"""Small tables with every awkward case, and brute-force versions of the operators."""

import random
import re

import numpy as np
import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed=3):
    """Texts with copies, near copies, shared passages, junk, long ones, empty ones and odd characters."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ha", "re", "to", "né", "sch", "ing", "ou", "日", "a"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = say(60), say(14)
    base = say(220)
    out = [None, "", " \t\n ", "one", "a b c", base, base, base.replace(" ", "  "), f"{say(40)} {passage} {say(30)}", f"{passage}\n{say(80)}", f"{say(20)}\n{passage}"]
    for _ in range(8):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{line}\n{say(30)}\n{say(25)}" for _ in range(8)]
    out += ["x " * 3000, "ab" * 4000, "same line\n" * 200, say(9000), "\U0001f600 <|endoftext|> 'll   end  \u0085", "MIT License and the Apache LICENSE, GNU General\nPublic License"]
    out += [f"{say(60)} ### $$$ &&& %%% *** " * 3 for _ in range(3)]
    return out


def rows(extra=0):
    """Documents in shuffled order, with repeated rows, a null id, one id for two texts and null columns."""
    made = [(i, t, "en" if i % 2 else None, f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts())]
    made += [made[5], made[5], (None, texts()[5], "en", None, None), (8, "other text of eight", "en", "s", 19)]
    random.Random(1).shuffle(made)
    return made + made[:extra]


def documents(spark, made=None):
    return spark.createDataFrame(rows() if made is None else made, SCHEMA).repartition(3)


def clashing(docs):
    """Extra columns whose names operators might use themselves."""
    for name in ("key", "bucket", "shard", "row", "n_words", "n_tokens", "score", "labels", "fp", "component_id", "gone", "parts", "labelled_id", "copied_id", "held_out", "row_key", "good", "kept", "start", "template", "line"):
        docs = docs.selectExpr("*", f"'x' as `{name}`")
    return docs


def covered(seqs, size):
    """seqs: (doc_id, sequence); for each: which units lie in a window that starts in a smaller document."""
    first = {}
    for d, x in seqs:
        if d is not None:
            for i in range(len(x) - size + 1):
                k = tuple(x[i : i + size])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, x in seqs:
        m = np.zeros(len(x), bool)
        for i in range(len(x) - size + 1):
            if d is not None and first[tuple(x[i : i + size])] < d:
                m[i : i + size] = True
        out.append(m)
    return out


def sample(name, sf, n=None):
    t = pq.read_table(f"{sf}/{name}.parquet")
    return t.slice(0, n).to_pydict() if n else t.to_pydict()
