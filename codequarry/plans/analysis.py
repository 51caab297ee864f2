"""From repositories to everything that is known of them: records, contexts, semantic layers, relationships."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import answers, enrich
from codequarry.operators.enrich import Provider
from codequarry.operators.knowledge import Knowledge, summary
from codequarry.operators.manifest import file_tree, in_skipped_dir, is_binary, manifest
from codequarry.plans.pipeline import extracted
from codequarry.sources import stores
from codequarry.sources.files import as_text, discover_local, read_files
from codequarry.sources.shared import new_folder
from codequarry.streaming.lease import single_flight
from codequarry.streaming.progress import ProgressLog


@dataclass
class Analysis:
    """What an analysis gives.

    repositories: repo, file_count, has_context, error. errors: repo, source_file, description.
    """

    kb: Knowledge
    apis: DataFrame
    relationships: DataFrame
    repositories: DataFrame
    errors: DataFrame


@dataclass
class Asker:
    """A provider with its model's name, a stored cache of answers (a folder), and a rate for each task."""

    provider: Provider
    model: str = "unknown"
    cache: str | None = None
    rate_per_minute: float = 0

    def ask(self, prompts: DataFrame) -> DataFrame:
        """prompts (key, prompt, ...) with answer, cached and error; a key holds for this model.

        Answers are written into the shared folder, so that none is asked for twice, whatever is made of them.
        """
        spark = prompts.sparkSession
        keyed = prompts.withColumn("key", F.substring(F.sha2(F.concat("key", F.lit(self.model)), 256), 1, 20))
        known = answers.stored_answers(spark, self.cache) if self.cache else None
        done = _written(enrich.complete(keyed, known, self.provider, self.rate_per_minute))
        if self.cache:
            answers.save_answers(done.where("not cached"), self.cache)
        return done


def _written(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contexts_of(files: DataFrame, asker: Asker) -> tuple[DataFrame, DataFrame]:
    """Contexts of the repositories of files (repo, path, content), and repositories (repo, file_count, has_context, error).

    A repository without usable files has no context and no error; one whose provider failed has the error.
    """
    usable = files.where(~in_skipped_dir(F.col("path")) & ~is_binary(F.col("path"), F.col("content")))
    done = asker.ask(answers.repo_prompts(manifest(files), file_tree(usable)))
    split = enrich.split_context(done.where("error is null"))
    contexts = answers.contexts(split, asker.model)
    told = done.select("repo", "file_count", F.col("error").isNull().alias("has_context"), "error")
    everyone = files.select("repo").distinct().join(told, "repo", "left")
    return contexts, everyone.select("repo", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("has_context", F.lit(False)).alias("has_context"), "error")


def _failed(done: DataFrame, what: str, repo: str = "repo") -> DataFrame:
    return done.where("error is not null").select(F.expr(repo).alias("repo"), F.lit(None).cast("string").alias("source_file"), F.concat(F.lit(f"{what}: "), "error").alias("description"))


def analyze(files: DataFrame, asker: Asker | None = None) -> Analysis:
    """Records of files (repo, path, content) and, with an asker, contexts, semantic layers and relationships.

    A semantic layer is asked for where a repository has a context and a schema, an API or a service; its descriptions
    are put into the records. Failures of one repository are rows of errors and don't touch the others. Records are
    written into the shared folder once, for all that is made of them.
    """
    spark = files.sparkSession
    found = ("schemas", "apis", "services", "dependencies")
    with extracted(files) as (kb, errors):
        kb, errors = replace(kb, **{n: _written(getattr(kb, n)) for n in found}), _written(errors)
    if asker is None:
        counts = files.groupBy("repo").agg(F.count("*").cast("int").alias("file_count"))
        none = spark.createDataFrame([], "kind string, body string")
        return Analysis(kb, kb.apis.withColumn("business_description", F.lit(None).cast("string")), none, counts.select("repo", "file_count", F.lit(False).alias("has_context"), F.lit(None).cast("string").alias("error")), errors)
    contexts, repositories = contexts_of(files, asker)
    kb = replace(kb, contexts=Knowledge.of(spark, contexts=contexts).contexts)
    some = kb.schemas.select("repo").union(kb.apis.select("repo")).union(kb.services.select("repo")).distinct()
    asked = asker.ask(answers.semantic_prompts(kb).join(some, "repo", "left_semi"))
    layers = enrich.salvage_json(asked, "answer")
    kb = replace(kb, semantic_layers=Knowledge.of(spark, semantic_layers=answers.semantic_layers(layers, asker.model)).semantic_layers)
    kb, apis = answers.apply_semantic(kb, layers)
    related = asker.ask(answers.relationship_prompts(kb.contexts))
    relationships = answers.answered_relationships(enrich.salvage_json(related, "answer"))
    errors = errors.unionByName(_failed(repositories, "context")).unionByName(_failed(asked, "semantic layer")).unionByName(_failed(related, "relationships", "cast(null as string)"))
    return Analysis(kb, apis, relationships, repositories, errors)


def crawl(spark: SparkSession, roots: list[str], out: str, log: ProgressLog, asker: Asker | None = None, then: Callable[[Knowledge], None] | None = None, exclude: list[str] = (), stale_seconds: float = 3600) -> Analysis:
    """A whole run over the repositories below roots, its stages in the log: out/store is a new version, out/docs the pages.

    then is called with the stored tables at the end. If a stage fails, the run ends as failed in the log and the store
    keeps the version it had. Runs into the same folder come one at a time: a second one raises Busy, unless the first
    has given no sign of life for stale_seconds.
    """
    with single_flight(spark, f"{out}/lease", "crawl", stale_seconds), log.job("crawl") as job:
        job.stage("discover", "Scanning local directories")
        repos = [str(p) for p in discover_local(list(roots), list(exclude))]
        job.log(f"Found {len(repos)} local repositories")
        job.stage("clone", "Skipped (local repos)")
        job.stage("analyze", f"Analyzing with {'LLM' if asker else 'pattern'} extraction")
        files = as_text(read_files(spark, *repos)) if repos else spark.createDataFrame([], "repo string, path string, content string")
        made = analyze(files, asker)
        s = summary(made.kb).first()
        job.log(f"Analysis complete: {len(repos)} repos, {s.total_schemas} schemas, {s.total_apis} APIs, {s.total_services} services, {s.total_dependencies} dependencies")
        job.stage("output", "Generating output files")
        stores.save(made.kb, f"{out}/store")
        stores.set_relationships(made.relationships, f"{out}/store")
        stores.save_tree(stores.load(spark, f"{out}/store"), f"{out}/docs", stores.get_relationships(spark, f"{out}/store"))
        job.stage("reloading", "Reloading knowledge base")
        if then:
            then(stores.load(spark, f"{out}/store"))
    return made
