"""Small tables for the operators' edge cases, and brute-force versions."""

import re

import duckdb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, _row string, hash long, label string, low int, tokens string, _w string"


def sentence(rng, n, words=("the", "of", "and", "to", "in", "a", "river", "stone", "light", "garden", "window", "paper", "music", "winter", "is", "that")):
    return " ".join(rng.choice(words) + (rng.choice([".", ",", ""]) if rng.random() < 0.2 else "") for _ in range(n))


def row(doc_id, text, lang="en", source="s0"):
    """A document with extra columns whose names the operators use inside."""
    return (doc_id, text, lang, source, len(text or ""), 7, None, "x", 5, "l", 3, "t", "w")


def odd_rows(rng):
    plain = sentence(rng, 120)
    texts = [None, "", " \n\t ", "one", "a b c", plain, plain, sentence(rng, 60), "x y z " * 80, "line\n" * 5 + sentence(rng, 70), "##$$ " * 60, "é ß 漢字 🙂 " * 30 + plain, sentence(rng, 30_000)]
    rows = [row(i, t, ["en", "fr", None, "xx"][i % 4], ["s0", "s1", None, ""][i % 4]) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[3], row(40, plain + " tail", "en", None)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def oracle(spark_frame, sql, tmp_path, table="documents"):
    """Rows of DuckDB's SQL over the frame, as dictionaries."""
    path = str(tmp_path / f"{table}.parquet")
    spark_frame.write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{path}/*.parquet'")
    found = con.sql(sql)
    return [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]


def same(spark_rows, expected):
    def plain(rows):
        return sorted((tuple(sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in r.items())) for r in rows), key=repr)

    assert plain([r.asDict() for r in spark_rows]) == plain(expected)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_components(docs):
    """doc_id -> smallest doc_id of its component; docs are (doc_id, text)."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in docs}
