"""Evidence for queries: the best texts and rules by shared tokens, with the rules' surroundings in the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdikt.functions.text import overlap, token_set
from verdikt.model import Policy
from verdikt.operators.graph import bounded_neighbourhood, neighbourhood, policy_graph, summary
from verdikt.tables import written

ACTION_BOOST = 0.35
EDGE_LIMIT = 120  # of one subgraph; a feature of the evidence, in the order of src, label, dst


def text_corpus(spark: SparkSession, policy: Policy) -> DataFrame:
    """evidence_id, text and rule_ids: rules' summaries and declared attributes."""
    rows = [(f"TXT_RULE_{r.rule_id}", summary(r), [r.rule_id]) for r in policy.rules]
    for scope, short in (("subject", "SUB"), ("resource", "RES")):
        rows += [(f"TXT_{short}ATTR_{a.name}", f"{scope} attribute {a.name} datatype={a.datatype}", []) for (s, _), a in policy.attributes.items() if s == scope]
    return spark.createDataFrame(rows, "evidence_id string, text string, rule_ids array<string>")


def shared_tokens(queries: DataFrame, corpus: DataFrame, query_id: str, query: str, text_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """q and n (its distinct tokens, 1 at least) of all queries; and q, d and shared of the texts that share tokens with them.

    Of the texts only tokens that some query has are kept, and these are dealt by text: where the queries' tokens are small
    enough for Spark to broadcast them, a text meets all queries in one place and its counts are whole there. No pair is
    shuffled then, though common words lead from nearly every query to nearly every text. Text ids are distinct.
    """
    asked = queries.select(F.col(query_id).alias("q"), token_set(F.col(query)).alias("tokens"))
    wanted = written(asked.select("q", F.explode("tokens").alias("token")), "wanted")  # a table, so its size is known
    places = 4 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number: else places are put together by their bytes, while each text of a place has a count for each query
    held = corpus.select(F.col(text_id).alias("d"), F.explode(token_set(F.col(text))).alias("token")).join(wanted.select("token").distinct(), "token", "left_semi").repartition(places, "d")
    return asked.select("q", F.greatest(F.lit(1), F.size("tokens")).alias("n")), held.join(wanted, "token").groupBy("q", "d").agg(F.count("*").alias("shared"))


def top_texts(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", query: str = "query", text_id: str = "evidence_id", text: str = "text") -> DataFrame:
    """query_id, rank, evidence_id and score of the k best texts of each query, ties to the larger id.

    Of a query's counts each task passes on its k best only (within a query the score grows with the count). If a query
    shares a token with fewer than k texts, the largest other ids follow with a score of 0: no more than k for a query, from the
    k largest ids and those of its matches.
    """
    sizes, shared = shared_tokens(queries, corpus, query_id, query, text_id, text)
    top = lambda rows, by: rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(by), F.desc("d")))).filter(F.col("rank") <= k)
    matched = written(top(shared, "shared").join(sizes, "q").select("q", "d", (F.col("shared") / F.col("n")).alias("score")), "matched")  # k rows a query
    short = sizes.join(matched.groupBy("q").agg(F.count("*").alias("m")), "q", "left").filter(F.coalesce("m", F.lit(0)) < k).select("q")
    last = corpus.select(F.col(text_id).alias("d")).orderBy(F.desc("d")).limit(2 * k)  # k of them aren't among k matches
    filled = short.join(F.broadcast(last)).join(matched.select("q", "d"), ["q", "d"], "left_anti").select("q", "d", F.lit(0.0).alias("score"))  # 2 k rows
    return top(matched.unionByName(filled), "score").select(F.col("q").alias(query_id), "rank", F.col("d").alias(text_id), "score")


def rule_score(query_tokens: Column, summary_tokens: Column, actions: list[str]) -> Column:
    """Overlap, and a boost for each action named in both."""
    named = F.array_intersect(F.array_intersect(query_tokens, summary_tokens), F.array(*(F.lit(a.lower()) for a in actions)).cast("array<string>"))
    return overlap(query_tokens, summary_tokens) + F.size(named) * F.lit(ACTION_BOOST)


def ranked_rules(query: Column, policy: Policy, k: int) -> Column:
    """The k best rules of a query, best first, ties to the larger id: structs of score and rule_id. The rules are a
    policy's, which is small: their scores are columns of the query, without a join."""
    if not policy.rules:
        return F.array().cast("array<struct<score:double,rule_id:string>>")
    scored = [F.struct(rule_score(token_set(query), token_set(F.lit(summary(r))), list(policy.actions)).alias("score"), F.lit(r.rule_id).alias("rule_id")) for r in policy.rules]
    return F.slice(F.sort_array(F.array(*scored), asc=False), 1, k)


def top_rules(queries: DataFrame, policy: Policy, k: int = 5, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, evidence_id (SG and the rank), rule_id and score of each query's k best rules, ties to the larger id."""
    ranked = queries.select(F.col(query_id).alias("q"), ranked_rules(F.col(query), policy, k).alias("top"))
    return ranked.select("q", F.posexplode("top").alias("at", "x")).select(F.col("q").alias(query_id), F.concat(F.lit("SG"), F.col("at") + 1).alias("evidence_id"), F.col("x.rule_id").alias("rule_id"), F.col("x.score").alias("score"))


def top_subgraphs(spark: SparkSession, queries: DataFrame, policy: Policy, k: int = 5, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """top_rules with node_ids and edges of each rule's two-hop neighbourhood (at most 120 edges, in order)."""
    _, edges = policy_graph(spark, policy)
    seeds = spark.createDataFrame([(f"Rule:{r.rule_id}", r.rule_id) for r in policy.rules], "seed string, rule_id string")
    found = neighbourhood(edges, seeds)
    ends = found.select("seed", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy("seed").agg(F.collect_list("node").alias("nodes"))  # all of them are in the result
    around = seeds.join(bounded_neighbourhood(edges, seeds, 2, EDGE_LIMIT), "seed", "left").join(ends, "seed", "left")
    shape = around.select("rule_id", F.array_sort(F.array_distinct(F.concat(F.array("seed"), F.coalesce("nodes", F.array().cast("array<string>"))))).alias("node_ids"), "edges")
    return top_rules(queries, policy, k, query_id, query).join(F.broadcast(shape), "rule_id").select(query_id, "evidence_id", F.array("rule_id").alias("rule_ids"), "node_ids", "edges", "score")


def evidence_by_rule(evidence: DataFrame, query_id: str = "query_id") -> DataFrame:
    """query_id, rule_id and the evidence ids that hold it."""
    return evidence.select(query_id, "evidence_id", F.explode("rule_ids").alias("rule_id")).groupBy(query_id, "rule_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))


def named_entities(queries: DataFrame, entities: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, pos, name and attributes of the first entity (least pos) whose name is a token of each query's text; no
    row without one. entities: pos, name, attributes (a map). Names are looked up by an equi-join on tokens, so there may be
    any number of both; names that are no single token are never found, and case doesn't matter."""
    said = queries.select(F.col(query_id), F.explode(token_set(F.col(query))).alias("token"))
    first = said.join(entities.select("pos", "name", F.lower("name").alias("token")), "token").groupBy(query_id).agg(F.min(F.struct("pos", "name")).alias("e"))
    found = first.select(query_id, F.col("e.pos").alias("__pos"), F.col("e.name").alias("__name"))
    return found.join(entities, (F.col("pos") == F.col("__pos")) & (F.col("name") == F.col("__name"))).select(query_id, "pos", "name", "attributes")


def said_pairs(query: Column) -> Column:
    """The key=value words of a text: an array of k (lower-cased) and v, in their order."""
    words = F.filter(F.split(F.replace(F.coalesce(query, F.lit("")), F.lit(","), F.lit(" ")), r"\s+"), lambda w: F.contains(w, F.lit("=")))
    return F.transform(words, lambda w: F.struct(F.lower(F.trim(F.substring_index(w, "=", 1))).alias("k"), F.trim(F.substr(w, F.instr(w, "=") + 1)).alias("v")))


def _sketched(found: DataFrame, columns: list[str], action: Column) -> DataFrame:
    """found (columns, __pairs, and for each scope __id and __attributes) as sketches: what pairs say goes before what is known."""

    def attributes(scope: str) -> Column:
        own = F.transform(F.filter("__pairs", lambda p: p.k.startswith(f"{scope}.")), lambda p: F.struct(F.substr(p.k, F.lit(len(scope) + 2)).alias("k"), p.v.alias("v")))
        keys = F.array_distinct(F.transform(own, lambda p: p.k))
        last = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(own, lambda p: p.k == k), -1).v)))
        known = F.coalesce(F.col(f"__{scope}_attributes"), F.create_map().cast("map<string,string>"))
        return F.map_concat(F.map_filter(known, lambda k, _: ~F.array_contains(keys, k)), last)

    said = F.try_element_at(F.filter("__pairs", lambda p: p.k == "action"), F.lit(-1)).getField("v")
    ids = [F.col(f"__{scope}_id").alias(f"{scope}_id") for scope in ("subject", "resource")]
    return found.select(*columns, F.coalesce(said, action).alias("action"), *ids, *(attributes(scope).alias(scope) for scope in ("subject", "resource")))


def sketch_requests(queries: DataFrame, users: DataFrame, resources: DataFrame, actions: list[str], query_id: str = "query_id", query: str = "query") -> DataFrame:
    """request_sketch for entities kept as tables (pos, name, attributes), of any number; query ids are distinct."""
    found = queries.withColumn("__pairs", said_pairs(F.col(query)))
    for scope, entities in (("subject", users), ("resource", resources)):
        named = named_entities(queries, entities, query_id, query).select(F.col(query_id).alias("__q"), F.col("name").alias(f"__{scope}_id"), F.col("attributes").alias(f"__{scope}_attributes"))
        found = found.join(named, F.col(query_id) == F.col("__q"), "left").drop("__q")
    words = token_set(F.col(query))
    first = F.coalesce(*(F.when(F.array_contains(words, a.lower()), a) for a in actions), F.lit(None).cast("string"))
    return _sketched(found, queries.columns, first)


def request_sketch(queries: DataFrame, policy: Policy, query: str = "query") -> DataFrame:
    """queries with action, subject_id, resource_id, and subject and resource (maps of text), as free text names them.

    The first action, user and resource of the policy whose name is a token of the text; then ``key=value`` words, where
    ``subject.k=v`` and ``resource.k=v`` set attributes and ``action=v`` the action. Keys are lower-cased.
    """
    text = lambda v: None if v is None else " ".join(sorted(map(str, v))) if isinstance(v, (set, list)) else str(v)
    spark = queries.sparkSession
    tables_ = [spark.createDataFrame([(n, name, {k: text(v) for k, v in values.items()}) for n, (name, values) in enumerate(own.items())], "pos int, name string, attributes map<string,string>") for own in (policy.users, policy.resources)]
    texts = queries.select(F.coalesce(query, F.lit("")).alias("__text")).distinct()  # equal texts have one sketch
    made = sketch_requests(texts, *tables_, list(policy.actions), "__text", "__text")
    return queries.join(made, F.coalesce(query, F.lit("")) == F.col("__text")).select(*queries.columns, "action", "subject_id", "resource_id", "subject", "resource")
