"""Recorded labelling responses: parsing, cache look-up, and scores against ground truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE_WORDS = ["true", "1", "yes"]  #: truthy cells of a truth file, in lower case


def answer_text(vendor: Column, body: Column) -> Column:
    """The text of the first answer in a body of one of three shapes; null for bodies that cannot be read, other
    vendors, and answers without text. Of a list of parts the first part's text is taken."""
    at = lambda path: F.get_json_object(body, path)
    content = F.try_variant_get(F.try_parse_json(body), "$.choices[0].message.content", "variant")
    first = F.when(F.schema_of_variant(content) == "STRING", at("$.choices[0].message.content")).otherwise(at("$.choices[0].message.content[0].text"))
    by_shape = F.when(vendor == "gpt4", first).when(vendor == "claude3", at("$.content[0].text")).when(vendor == "gemini1.5", body)
    return F.when(F.try_parse_json(body).isNotNull(), by_shape)


ANSWER_KEYS = ("primary", "focus")  #: keys under which answers have said that an area matters, the first that is there counts


def with_labels(rows: DataFrame, text: str, keys: tuple[str, ...] = ANSWER_KEYS) -> DataFrame:
    """``rows`` with ``labels``, a map label -> whether it is primary, and ``places``, the labels in the order of the
    answer, from the first '[' to the first ']' of a text: an array of objects with id and one of ``keys``. Null if
    that is no such array; of repeated ids the last value wins, at the place of the first.

    Each step is a column of its own, so that nothing is parsed twice.
    """
    opens, closes = F.instr(text, "["), F.instr(text, "]")
    found = rows.withColumn("_cut", F.when((opens > 0) & (closes > opens), F.substr(text, opens, closes - opens + 1)))
    fields = ",".join(f"{k}:boolean" for k in keys)
    found = found.withColumn("_items", F.when(F.try_parse_json("_cut").isNotNull(), F.from_json("_cut", f"array<struct<id:string,{fields}>>", {"mode": "PERMISSIVE"})))
    value = lambda x: F.coalesce(*[x[k] for k in keys])
    usable = F.forall("_items", lambda x: x["id"].isNotNull() & value(x).isNotNull())
    in_order = F.transform("_items", lambda x: F.struct(F.upper(F.trim(x["id"])).alias("label"), value(x).alias("value")))
    found = found.withColumn("_pairs", F.when(usable, in_order)).withColumn("_back", F.reverse("_pairs")).withColumn("places", F.array_distinct("_pairs.label"))
    values = F.transform("places", lambda label: F.get(F.col("_back.value"), (F.array_position("_back.label", label) - 1).cast("int")))
    return found.withColumn("labels", F.map_from_arrays("places", values)).drop("_cut", "_items", "_pairs", "_back")


def distinct_responses(responses: DataFrame) -> DataFrame:
    """Repeated rows read once, by id."""
    return responses.groupBy("response_id").agg(F.max(F.struct("received_at", "artifact_id", "vendor", "body")).alias("r")).select("response_id", "r.*")


def parsed_responses(responses: DataFrame) -> DataFrame:
    """(response_id, artifact_id, labels, places): the label map of each response and its order, null where there is none."""
    texts = distinct_responses(responses).select("response_id", "artifact_id", answer_text(F.col("vendor"), F.col("body")).alias("text"))
    return with_labels(texts, "text").select("response_id", "artifact_id", "labels", "places")


def _exploded(parsed: DataFrame, key: str) -> DataFrame:
    """(key, label, is_primary). Exploding outer keeps Catalyst from pushing a null check below the parsing, where it
    would be written out once for each step."""
    return parsed.select(key, F.explode_outer("labels").alias("label", "is_primary")).where("label is not null")


def label_rows(responses: DataFrame) -> DataFrame:
    """(response_id, label, is_primary) of every response that can be parsed."""
    return _exploded(parsed_responses(responses), "response_id")


def latest_labels(responses: DataFrame) -> DataFrame:
    """(artifact_id, label, is_primary) by the last response of an artifact that can be parsed."""
    known = F.when(F.col("labels").isNotNull(), F.col("response_id"))
    return _exploded(parsed_responses(responses).groupBy("artifact_id").agg(F.max_by("labels", known).alias("labels")), "artifact_id")


def latest_places(responses: DataFrame) -> DataFrame:
    """As ``latest_labels``, with ``place``, the label's position in the answer from 0."""
    known = F.when(F.col("labels").isNotNull(), F.col("response_id"))
    last = parsed_responses(responses).groupBy("artifact_id").agg(F.max_by(F.struct("labels", "places"), known).alias("r"))
    placed = last.select("artifact_id", F.col("r.labels").alias("labels"), F.posexplode_outer("r.places").alias("place", "label")).where("label is not null")
    return placed.select("artifact_id", "label", F.element_at("labels", F.col("label")).alias("is_primary"), "place")


def cache_misses(artifacts: DataFrame, responses: DataFrame) -> DataFrame:
    """The artifacts without any response whose body is not null: those to be asked (again)."""
    return artifacts.select("artifact_id").distinct().join(responses.where("body is not null").select("artifact_id"), "artifact_id", "left_anti")


def ask_missing(artifacts: DataFrame, responses: DataFrame, client: Callable[[str], str | None], vendor: str, parallel: int = 8) -> DataFrame:
    """(artifact_id, vendor, body): the answers of a labelling service for the artifacts that have none yet.

    ``client`` takes an artifact id and gives a body; it is called in the workers, once for each artifact. A call
    that fails gives a null body, which a later run asks again.
    """

    def ask(batches):
        for batch in batches:
            bodies = []
            for artifact in batch["artifact_id"]:
                try:
                    bodies.append(client(artifact))
                except Exception:  # noqa: BLE001
                    bodies.append(None)
            yield batch.assign(vendor=vendor, body=bodies)

    return cache_misses(artifacts, responses).repartition(parallel).mapInPandas(ask, "artifact_id string, vendor string, body string")


def truth_labels(area_labels: DataFrame) -> DataFrame:
    """(artifact_id, label, is_primary): labels trimmed in upper case, repeated ones once (true if any is), null as false."""
    label = F.upper(F.trim("label"))
    return area_labels.where(F.col("artifact_id").isNotNull() & F.col("label").isNotNull()).groupBy("artifact_id", label.alias("label")).agg(F.max(F.coalesce("is_primary", F.lit(False))).alias("is_primary"))


def parse_truth_cell(cell: Column) -> Column:
    """Whether a cell of a truth file is truthy."""
    return F.lower(F.trim(cell)).isin(TRUE_WORDS)


def artifact_scores(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """(artifact_id, n_labels, n_right, score): the share of an artifact's true labels that its answer got right; a
    label that the answer lacks is a miss."""
    both = truth.join(labels.withColumnRenamed("is_primary", "said"), ["artifact_id", "label"], "left")
    right = F.count_if(F.coalesce(F.col("said") == F.col("is_primary"), F.lit(False)))
    return both.groupBy("artifact_id").agg(F.count("*").alias("n_labels"), right.alias("n_right")).withColumn("score", F.round(F.col("n_right") / F.col("n_labels"), 6))


def overall_score(artifacts: DataFrame, scores: DataFrame) -> DataFrame:
    """The mean score of all artifacts; those without truth count as 0."""
    every = artifacts.select("artifact_id").distinct().join(scores, "artifact_id", "left")
    return every.agg(F.count("*").alias("n_artifacts"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("mean_score"))


def letter_bias(labels: DataFrame) -> DataFrame:
    """(label, n_primary, n_secondary) over all label rows."""
    return labels.groupBy("label").agg(F.count_if("is_primary").alias("n_primary"), F.count_if(~F.col("is_primary")).alias("n_secondary"))


def color_bias(labels: DataFrame, prompts: DataFrame) -> DataFrame:
    """(color_name, n_primary, n_secondary): labels joined with the color their prompt gives them."""
    line = F.explode(F.split("prompt", "\n")).alias("line")
    m = r"^([A-Z]), (\p{L}.*)$"  # a color may have several words
    given = prompts.select("response_id", line).where(F.col("line").rlike(m)).select("response_id", F.regexp_extract("line", m, 1).alias("label"), F.trim(F.regexp_extract("line", m, 2)).alias("color_name")).distinct()
    return labels.join(given, ["response_id", "label"]).groupBy("color_name").agg(F.count_if("is_primary").alias("n_primary"), F.count_if(~F.col("is_primary")).alias("n_secondary"))
