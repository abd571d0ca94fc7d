"""SQL twins of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _similar(words: int, percent: int, columns: str) -> str:
    """Components of documents whose sets of shingles are similar enough.

    A smaller id only is carried on: on every way to the smallest id of a component, all ids are larger.
    """
    return rf"""
        WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
        places AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {words - 1}, 1) + 1)) AS i FROM split WHERE len(words) > 0),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + {words - 1}], ' ') AS shingle FROM places),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (
            SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * p.n >= {percent} * (x.n + y.n - p.n)),
        reached AS (
            SELECT doc_id, doc_id AS top FROM documents
            UNION SELECT b, top FROM reached JOIN links ON a = doc_id WHERE top < b)
        SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(top) AS {columns}
        FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Components as rows, rounds as one step after another."""
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row_no, vec_id, label, embedding
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        places AS (SELECT row_no, embedding, unnest(range(len(embedding))) AS i, len(embedding) // {parts} AS width FROM kept),
        cells AS (SELECT row_no, i // width AS part, i % width AS pos, floor(1024 * embedding[i + 1]::DOUBLE)::BIGINT AS x FROM places),
        book0 AS (SELECT part, row_no - 1 AS entry, pos, x FROM cells WHERE row_no <= {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
        far{r} AS (SELECT c.row_no, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d
                   FROM cells c JOIN book{r} b ON b.part = c.part AND b.pos = c.pos GROUP BY ALL),
        near{r} AS (SELECT row_no, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM far{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
        sum{r} AS (SELECT part, n.entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM cells c JOIN near{r} n USING (row_no, part) GROUP BY ALL),
        book{r + 1} AS (SELECT part, entry, pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x
                        FROM book{r} LEFT JOIN sum{r} USING (part, entry, pos))""")
    return "WITH " + ",".join(steps) + f""",
        codes AS (SELECT row_no, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
                  FROM near{rounds} GROUP BY row_no),
        digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{rounds})
        SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
        FROM kept JOIN codes USING (row_no), digest"""


ORACLE_SQL = {
    "op2_near_dedup": _similar(5, 75, "component_id, r.doc_id = min(top) AS kept"),
    "op7_exact_dedup": f"""
        WITH keyed AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM keyed WINDOW g AS (PARTITION BY norm)""",
    # Every group times every kept term of its language, all in 128 bits.
    "op11_source_divergence": r"""
        WITH docs AS (SELECT row_number() OVER () AS row_no, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        places AS (SELECT row_no, lang, source, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS n FROM places GROUP BY lang, term HAVING count(DISTINCT row_no) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        counted AS (SELECT lang, source, term, count(*) AS n FROM places GROUP BY ALL),
        cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang FROM groups g JOIN kept k ON k.lang = g.lang
                  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
        ps AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (t.total + l.v))::HUGEINT AS p,
                      (1 + 1000000000::HUGEINT * (n_lang + 1) // (l.total + l.v))::HUGEINT AS q
               FROM cells JOIN totals t USING (lang, source) JOIN langs l USING (lang)),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                 FROM ps a JOIN ps b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
                  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM ps WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
                   FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op12_ngram_join": _similar(4, 85, "component_id"),
    "op13_vector_codes": _vector_codes(),
}
