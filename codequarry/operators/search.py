"""Keyword search over all kinds of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import has, match_score, match_score_all, text
from codequarry.operators.knowledge import Knowledge, recipes

RECIPE_WEIGHT = 1.5


def top_matches(df: DataFrame, query: str, columns: list[str], limit: int, order: str = "ord") -> DataFrame:
    """Rows of one table by score, ties in order; a top-k without a full sort."""
    scored = df.withColumn("score", match_score(query, *columns)).where("score > 0")
    return scored.orderBy(F.desc("score"), order).limit(limit)


def hits(kb: Knowledge, query: str) -> DataFrame:
    """All records that match: kind, name, repo, score, data (JSON), and branch and ord for ties."""
    names = lambda c, part: F.transform(c, lambda x: text(x[part]))
    fields = F.concat(names("fields", "name"), names("fields", "type"), names("fields", "description"))

    def branch(k: int, kind: str, df: DataFrame, name, score, repo="repo") -> DataFrame:
        data = F.to_json(F.struct(*df.columns))
        return df.select(F.lit(kind).alias("kind"), name.alias("name"), F.col(repo).alias("repo"), score.alias("score"), data.alias("data"), F.lit(k).alias("branch"), "ord")

    endpoint = F.concat(F.coalesce("method", F.lit("?")), F.lit(" "), F.coalesce("path", F.lit("?")))
    found = branch(1, "schema", kb.schemas, F.col("name"), match_score(query, "name", "description") + match_score_all(query, fields))
    found = found.unionByName(branch(2, "api", kb.apis, endpoint, match_score(query, "path", "method", "handler", "description")))
    found = found.unionByName(branch(3, "service", kb.services, F.col("name"), match_score(query, "name", "description") + match_score_all(query, names("methods", "name"))))
    found = found.unionByName(branch(4, "dependency", kb.dependencies, F.col("name"), match_score(query, "name", "ecosystem")))
    found = found.unionByName(branch(5, "recipe", recipes(kb.semantic_layers), text("question"), match_score(query, "question", "answer_format") * RECIPE_WEIGHT))
    return found.where("score > 0")


def search(kb: Knowledge, query: str, limit: int = 20, kind: str = "", repo: str = "") -> DataFrame:
    """The best hits. Kind and repository filter after the limit, so fewer rows may be left."""
    top = hits(kb, query).orderBy(F.desc("score"), "branch", "ord").limit(limit)
    top = top.where(F.col("kind") == kind) if kind else top
    return top.where(has("repo", repo)) if repo else top
