"""What does not depend on a query, stored: postings, spellings, adjacency and links of each user; and searches that only read it.

Tables are divided into buckets of users and sorted by user and term or node, so a search reads one folder and few row groups of it;
a user with a third of all rows has many files of its own. Small things of a search (tokens, clauses, seeds: at most some thousand rows by
the limits of a query) go through the driver as literals of the next statement.
"""

from __future__ import annotations

import itertools
import math
import uuid

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import TOKEN
from threadloom.operators import graph, lexical, retrieve
from threadloom.sources.store import Store

#: Terms up to this length are found by their spellings with letters left out; longer ones, few in any vocabulary, by comparison.
SPELLED = 24
_TOKENS = regex.compile(TOKEN)
TABLES = ("posts", "spellings", "terms", "corpus", "near", "links")


def _without_one(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))


def spellings(terms: DataFrame) -> DataFrame:
    """(spelling, term, left_out): each term with none, one or two of its letters left out (two from five letters on), for terms up to SPELLED + 2 letters.

    Two words within d edits, a swap of neighbours counting as one, share a spelling that leaves out at most d letters of each.
    """
    short = terms.filter(F.length("term") <= SPELLED + 2).select("term")
    once = F.when(F.length("term") > 1, _without_one(F.col("term"))).otherwise(F.array().cast("array<string>"))
    twice = F.when(F.length("term") > 4, F.flatten(F.transform(once, _without_one))).otherwise(F.array().cast("array<string>"))
    made = short.select("term", F.array(F.struct(F.array("term").alias("s"), F.lit(0).alias("n")), F.struct(once.alias("s"), F.lit(1).alias("n")), F.struct(twice.alias("s"), F.lit(2).alias("n"))).alias("x"))
    rows = made.select("term", F.explode("x").alias("x")).select("term", F.col("x.n").alias("left_out"), F.explode(F.array_distinct("x.s")).alias("spelling"))
    return rows.select("spelling", "term", "left_out")


def _spelled(token: str, most: int) -> dict[str, int]:
    """The spellings of a query's token with how many letters each leaves out."""
    out = {token: 0}
    for n in range(1, most + 1):
        for places in itertools.combinations(range(len(token)), n):
            gone = set(places)
            out.setdefault("".join(c for i, c in enumerate(token) if i not in gone), n)
    return out


def build(store: Store, fragments: DataFrame, nodes: DataFrame, mapping: DataFrame, buckets: int | None = None) -> None:
    """Write the tables of a search over `fragments` (fragment_id, message_id, user_id, text), their nodes and mappings, as a new version each.

    A bucket holds about a million fragments, or as `buckets` says.
    """
    buckets = buckets or max(1, fragments.count() // 1_000_000)
    parts = max(2 * buckets, int(store.spark.conf.get("spark.sql.shuffle.partitions")) if buckets > 1 else 1)
    bucket = F.pmod("user_id", F.lit(buckets)).cast("int").alias("ub")
    own = fragments.filter("user_id is not null")

    def keep(df: DataFrame, name: str, *order: str) -> None:
        store.replace(df.select(bucket, "*").repartitionByRange(parts, "ub", *order).sortWithinPartitions("ub", *order), name, ["ub"])

    # terms of all fragments count, those of users are found
    posts = lexical.postings(fragments, "fragment_id", "text", ["user_id", "message_id"])
    keep(posts.filter("user_id is not null"), "posts", "user_id", "term")
    terms = lexical.term_stats(posts)
    store.replace(terms, "terms")
    terms = store.read("terms")
    made = spellings(terms).join(terms.select("term", "df"), "term")
    store.replace(made.repartitionByRange(parts, "spelling").sortWithinPartitions("spelling"), "spellings")
    store.replace(lexical.corpus_stats(fragments, "text").withColumn("buckets", F.lit(buckets)), "corpus")
    known = graph.known_mapping(mapping, fragments, nodes)
    keep(graph.stored_adjacency(known, fragments, nodes).select("user_id", "node", "neighbor", "npmi", "edge_rank"), "near", "user_id", "node")
    users = nodes.filter("node_id is not null").select("node_id", "user_id")
    placed = known.join(own.select("fragment_id", "message_id"), "fragment_id").join(users, "node_id").filter("user_id is not null")
    keep(placed.select("user_id", "node_id", "fragment_id", "mapping_id", "message_id"), "links", "user_id", "node_id")


class Serving:
    """Searches over the stored tables. `refresh` takes in what was built since."""

    def __init__(self, store: Store) -> None:
        self.store, self.spark = store, store.spark
        self._tag = uuid.uuid4().hex[:8]
        self.refresh()

    def refresh(self) -> None:
        for name in TABLES:
            found = self.store.read(name)
            if found is None:
                raise ValueError(f"the store has no table {name}: build it first")
            found.createOrReplaceTempView(self._view(name))
        stats = self.store.read("corpus").first()
        self.n_docs, self.avgdl, self.buckets = stats.n_docs, stats.avgdl, stats.buckets

    def _view(self, name: str) -> str:
        return f"serving_{name}_{self._tag}"

    def _of(self, name: str, user_id: int) -> str:
        """The rows of a user: the table, its folder and the user."""
        return f"{self._view(name)} WHERE ub = {user_id % self.buckets} AND user_id = {user_id}"

    def table(self, name: str, user_id: int) -> DataFrame:
        """The rows of a user in a stored table."""
        return self.spark.sql(f"SELECT * FROM {self._of(name, user_id)}")

    # ---- lexical ----
    def clauses(self, query: str, fuzzy: bool = True) -> list[tuple[str, str, int, float]]:
        """(token, term, df, boost): the exact term of each distinct token, and its expansions as `lexical.fuzzy_terms` gives them, with their largest df."""
        tokens = list(dict.fromkeys(_TOKENS.findall(query.lower())))
        most = {t: 0 if len(t) <= 2 or not fuzzy else 2 if len(t) >= 7 else 1 for t in tokens}
        parts = []
        spelled = [f"('{s}','{t}',{most[t]})" for t in tokens if len(t) <= SPELLED for s, n in _spelled(t, most[t]).items()]
        if spelled:
            parts.append(f"SELECT DISTINCT token, term, df, most FROM (SELECT /*+ REPARTITION(token), BROADCAST(q) */ token, term, df, most, left_out FROM {self._view('spellings')} JOIN (VALUES {','.join(spelled)}) AS q(spelling, token, most) USING (spelling) WHERE left_out <= most)")
        long = [f"('{t}',{most[t]})" for t in tokens if len(t) > SPELLED]
        if long:
            parts.append(f"SELECT token, term, df, most FROM {self._view('terms')} JOIN (VALUES {','.join(long)}) AS q(token, most) ON abs(length(term) - length(token)) <= most WHERE length(term) > {SPELLED - 2}")
        if not parts:
            return []
        near = f"SELECT token, term, df, {lexical.within('token', 'term', 'most')} AS edits FROM ({' UNION ALL '.join(parts)})"
        ranked = f"SELECT *, row_number() OVER (PARTITION BY token ORDER BY boost DESC, term) AS rn FROM (SELECT *, {lexical.BOOST} AS boost FROM ({near}) WHERE edits IS NOT NULL)"
        exact, fuzz = {}, {}
        # at most FUZZY_EXPANSIONS and the exact term for each of at most 250 tokens
        for r in self.spark.sql(f"SELECT token, term, df, edits, boost FROM ({ranked}) WHERE rn <= {lexical.FUZZY_EXPANSIONS}").toArrow().to_pylist():
            if r["edits"] == 0:
                exact[r["token"]] = r["df"]
            if most[r["token"]]:
                fuzz.setdefault(r["token"], []).append(r)
        out = [(t, t, exact[t], lexical.EXACT_BOOST) for t in tokens if t in exact]
        for t, rows in fuzz.items():
            df = max(r["df"] for r in rows)
            out += [(t, r["term"], df, r["boost"]) for r in rows]
        return out

    def lexical(self, user_id: int, query: str, limit: int = 50, fuzzy: bool = True) -> list[tuple[int, int | None, float]]:
        """(fragment_id, message_id, score) of the user's best fragments, as `lexical.search_index` scores them; at most 100 rows."""
        lexical.check_query(query, user_id, limit)
        clauses = self.clauses(query, fuzzy)
        if not clauses:
            return []
        idf = lambda df: math.log(1 + (self.n_docs - df + 0.5) / (df + 0.5))
        values = ",".join(f"('{token}','{term}',{boost == lexical.EXACT_BOOST},{boost * idf(df)!r}D)" for token, term, df, boost in clauses)
        part = f"w * tf / (tf + 1.2D * (0.25D + 0.75D * dl / {float(self.avgdl)!r}D))"
        rows = self.spark.sql(f"""
            SELECT fragment_id, message_id, sum(greatest(coalesce(a, 0D), coalesce(b, 0D))) AS score FROM (
                SELECT fragment_id, message_id, token, sum(CASE WHEN exact THEN {part} END) AS a, sum(CASE WHEN NOT exact THEN {part} END) AS b FROM (
                    SELECT /*+ REPARTITION(fragment_id), BROADCAST(c) */ fragment_id, message_id, token, exact, w, tf, dl
                    FROM (SELECT term, fragment_id, message_id, tf, dl FROM {self._of('posts', user_id)}) p JOIN (VALUES {values}) AS c(token, term, exact, w) USING (term))
                GROUP BY fragment_id, message_id, token)
            GROUP BY fragment_id, message_id ORDER BY score DESC, fragment_id LIMIT {limit}""")
        return [(r["fragment_id"], r["message_id"], r["score"]) for r in rows.toArrow().to_pylist()]

    # ---- graph ----
    def _beside(self, name: str, user_id: int, columns: str, key: str, rows: dict[int, float]) -> DataFrame:
        """The user's rows of a table whose `key` is in `rows`, with the row's score; `rows` are bounded by the limits of a traversal."""
        small = self.spark.createDataFrame(pa.table({key: pa.array(rows, pa.int64()), "score": pa.array(rows.values(), pa.float64())}))
        return self.spark.sql(f"SELECT {columns} FROM {self._of(name, user_id)}").join(F.broadcast(small), key)

    def reached(self, user_id: int, seeds: list[tuple[int, float]], hops: int = graph.HOPS, most: int = graph.MOST_NODES) -> dict[int, float]:
        """node -> score as `graph.traverse` from the nodes of the seed fragments.

        With at most 3 edges a node, hop h starts from at most `most` * 3**h nodes: each hop is one look-up in the user's adjacency, without a shuffle.
        """
        fine = lambda x: {n: s for n, s in x.items() if 0 < s < float("inf")}
        found = self._beside("links", user_id, "node_id, fragment_id", "fragment_id", dict(seeds)).groupBy("node_id").agg(F.max("score").alias("score"))
        roots = found.filter("score > 0 and score < double('infinity')").orderBy(F.col("score").desc(), "node_id").limit(most).toArrow().to_pylist()
        frontier = {r["node_id"]: r["score"] for r in roots}
        score, hop = dict(frontier), {n: (0, -s) for n, s in frontier.items()}
        for h in range(1, hops + 1):
            if not frontier:
                break
            steps = self._beside("near", user_id, "node, neighbor, npmi", "node", frontier).selectExpr("neighbor", "score * npmi AS score").toArrow()
            frontier = {}
            for n, s in zip(steps["neighbor"].to_pylist(), steps["score"].to_pylist()):
                frontier[n] = max(s, frontier.get(n, s))
            frontier = fine(frontier)
            for n, s in frontier.items():
                score[n] = max(s, score.get(n, s))
                hop.setdefault(n, (h, -s))
        return {n: score[n] for n in sorted(score, key=lambda n: (hop[n][0], -score[n], n))[:most]}

    def fused(self, user_id: int, hits: list[tuple[int, int | None, float]], seed: str = "0", limit: int = retrieve.MOST_MESSAGES) -> list[tuple[int, float]]:
        """(message_id, score): the fusion of the lexical hits with the fragments that the graph reaches from their seeds, best first.

        Of the graph's list only its first `limit` messages and the ranks of the lexical ones (at most 100) can matter: any `limit` messages
        at its head outscore all that follow and are in no other list. So nothing is ranked as a whole: the head is a top-k, ranks are counts.
        """
        first = retrieve.order_few(hits)
        nodes = self.reached(user_id, retrieve.seeds_few([(f, s) for f, _, s in hits], seed)) if hits else {}
        if not nodes:
            return retrieve.fuse_ranks([{m: i for i, m in enumerate(first, 1)}], limit=limit)
        links = self._beside("links", user_id, "node_id, fragment_id, message_id", "node_id", nodes).filter("message_id is not null")
        found = links.groupBy("message_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("fragment_id").alias("f"), F.col("message_id").alias("m"))).alias("o"))
        asked = F.col("message_id").isin(first).alias("asked")
        top = found.select("o", asked).orderBy(F.col("asked").desc(), "o").limit(limit + len(first)).toArrow().to_pylist()
        order = sorted((r["o"]["s"], r["o"]["f"], r["o"]["m"], r["asked"]) for r in top)
        # the head is whole as far as the last of the other messages taken, or to the end where all were taken
        others = [i for i, o in enumerate(order) if not o[3]]
        whole = len(order) if len(order) < limit + len(first) else others[-1] + 1 if others else 0
        ranks = {o[2]: i for i, o in enumerate(order[:whole], 1)}
        late = [o for o in order[whole:] if o[3]]
        if late:
            counts = [F.count_if(F.expr(f"o < struct({s!r}D AS s, {f}L AS f, {m}L AS m)")).alias(f"c{i}") for i, (s, f, m, _) in enumerate(late)]
            row = found.agg(*counts).first()
            ranks |= {o[2]: row[i] + 1 for i, o in enumerate(late)}
        return retrieve.fuse_ranks([{m: i for i, m in enumerate(first, 1)}, ranks], limit=limit)
