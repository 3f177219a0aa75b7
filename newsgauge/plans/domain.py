"""The media domain laid over the given tables: which columns play surveys, sources, posts, texts and vectors.

Survey rows are orders by ISO week and priority; posts are line items, sources are suppliers and media
groups are regions; texts are documents, vectors are embeddings and previews are pages.
"""
from __future__ import annotations

from functools import cached_property


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgauge.functions.dates import window_days
from newsgauge.functions.text import squeeze, uniform
from newsgauge.operators import coverage as C
from newsgauge.operators import framing as FR
from newsgauge.operators import relevance as RL
from newsgauge.operators import retrieval as RT
from newsgauge.operators import texts as X
from newsgauge.operators import themes as TH
from newsgauge.operators import vocabulary as V
from newsgauge.operators.scaling import rank_by_score
from newsgauge.session import cut_point, summary

NON_RESPONSE = ["5-LOW"]
CATCH_ALL = ["4-NOT SPECIFIED"]
ARCHIVED_NATION = 24
FULLTEXT_FROM = 1996
RANK_EDGES = (0, 150, 500, 1000, 2000, 3000)
# Common words of the four languages, a small stop list.
STOPWORDS = ["the", "and", "of", "to", "in", "that", "is", "for", "with", "on", "as", "der", "die", "das", "und", "ein", "den", "le", "la",
             "les", "de", "des", "un", "une", "et", "que", "qui", "pour", "dans", "el", "los", "las", "en", "por", "con", "sie", "ich", "nicht"]


_OPEN: dict[tuple[str, str], "Domain"] = {}


def open_domain(spark: SparkSession, folder: str) -> Domain:
    """One domain per application and folder, so the tables many queries read are written once."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _OPEN:
        _OPEN[key] = Domain(spark, folder)
    return _OPEN[key]


class Domain:
    """Lazily built DataFrames over one data folder.

    Tables that feed many others are cut points: written to the shared folder when first read, as the
    warehouse they belong to keeps them as tables. Written dimensions also have a known size, so Spark
    sends them to every task only while they are small. Everything else stays a plan.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ------------------------------------------------------------------ survey
    @cached_property
    def raw_survey(self) -> DataFrame:
        week = F.date_trunc("week", "o_orderdate").cast("date")
        n = self.table("orders").groupBy(week.alias("monday"), F.col("o_orderpriority").alias("event")).agg(
            F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("o_orderstatus")).alias("states"))
        total = n.groupBy("monday").agg(F.sum("n").alias("tot"))
        thursday = F.date_add("monday", 3)
        single = F.concat(F.lit("['«"), F.array_join("states", "»', '«"), F.lit("»']"))
        double = F.concat(F.lit('["«'), F.array_join("states", '»", "«'), F.lit('»"]'))
        description = (
            F.when(F.col("n") == 1, "").when(F.col("n") == 2, "[]").when(F.col("n") == 3, "said in passing")
            .when(F.weekofyear("monday") % 2 == 0, single).otherwise(double))
        return n.join(total, "monday").select(
            F.year(thursday).alias("year"), F.weekofyear("monday").alias("week"), "event", description.alias("description"),
            F.when(F.col("n") > 1, F.round(F.lit(100.0).cast("double") * F.col("n") / F.col("tot"), 4)).alias("percentage"))

    @cached_property
    def survey(self) -> DataFrame:
        staged = C.stage_survey(self.raw_survey, NON_RESPONSE, CATCH_ALL)
        suffix = F.when(F.col("survey_year") >= FULLTEXT_FROM, "_fulltext").otherwise("")
        digit = F.substring("event_name", 1, 1).cast("int")
        named = staged.withColumn("digit", digit).withColumn(
            "event_slug", F.concat(F.format_string("event_%dw%02d_%d", "survey_year", "survey_week", "digit"), suffix))
        return cut_point(named, "survey")

    # ------------------------------------------------------------------ sources and posts
    @cached_property
    def all_sources(self) -> DataFrame:
        rows = (
            self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("source_name"), F.lower("r_name").alias("media_group_key"),
                    F.col("r_name").alias("media_group"), "n_nationkey"))
        return cut_point(rows, "sources")

    @cached_property
    def groups(self) -> DataFrame:
        return self.all_sources.filter(F.col("n_nationkey") != ARCHIVED_NATION).drop("n_nationkey").withColumn(
            "is_grouped", F.lit(True))

    @cached_property
    def archived(self) -> DataFrame:
        return self.all_sources.filter(F.col("n_nationkey") == ARCHIVED_NATION).select(
            "source_name", F.concat(F.lit("reason_"), F.col("media_group_key")).alias("reason"))

    @cached_property
    def posts(self) -> DataFrame:
        """The whole corpus of posts, archived sources included."""
        json = F.concat(F.lit('{"_":"Message","id":'), F.col("l_partkey"), F.lit(',"message":"post '), F.col("l_returnflag"),
                        F.lit(" on part "), F.col("l_partkey"), F.lit('"}'))
        text = (
            F.when(F.col("l_partkey") % 7 == 0, '{"_":"Message"').when(F.col("l_linestatus") == "O", json)
            .when(F.col("l_partkey") % 11 == 0, '{"_":"Service"}')
            .otherwise(F.concat(F.lit("plain post on part "), F.col("l_partkey"))))
        return self.table("lineitem").select(
            F.concat(F.lit("s"), F.col("l_suppkey")).alias("source_name"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("message_id"),
            F.col("l_shipdate").alias("published_at"), F.to_date("l_shipdate").alias("published_date"),
            (F.col("l_linestatus") == "O").alias("is_digest"),
            F.concat(F.lit("about part "), F.col("l_partkey")).alias("summary"), text.alias("original_message"),
            (F.col("l_quantity").cast("long") * 100).alias("views"),
            F.when(F.col("l_returnflag") != "R", F.col("l_quantity") * 2).alias("forwards"),
            (F.col("l_discount") + 0.5).alias("cosine_max"), (F.lit(1) - F.col("l_discount")).alias("rerank_score"),
            (F.col("l_tax") > 0.04).alias("keyword_match"),
            F.col("l_partkey").alias("topic"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))

    @cached_property
    def activity(self) -> DataFrame:
        return cut_point(C.source_activity(self.posts, self.archived), "activity")

    @cached_property
    def day_posts(self) -> DataFrame:
        return C.corpus_day_posts(self.posts)

    @cached_property
    def measured(self) -> DataFrame:
        """Survey rows whose posts were searched."""
        return self.survey.filter((F.col("survey_week") % 4 != 0) & (F.col("digit") <= 3))

    @cached_property
    def raw_matches(self) -> DataFrame:
        """Posts found for each searched event, before archived sources are dropped."""
        days = self.measured.select(
            "event_id", "event_slug", "survey_week", (F.col("digit") - 1).cast("long").alias("slot"),
            window_days(F.col("match_start"), F.col("match_end_exclusive")).alias("published_date"))
        posts = self.posts.withColumn("slot", F.col("topic") % 5)
        return (
            posts.join(days, ["published_date", "slot"])
            .filter((F.col("topic") * 7 + F.col("survey_week")) % 11 < 2)
            .drop("slot", "topic", "line", "flag", "survey_week"))

    @cached_property
    def matches(self) -> DataFrame:
        return self.raw_matches.join(self.archived.select("source_name"), "source_name", "left_anti")

    @cached_property
    def datasets(self) -> DataFrame:
        """How each searched event's set was built."""
        counts = self.raw_matches.join(self.archived.select("source_name", F.lit(1).alias("out")), "source_name", "left").groupBy(
            "event_id").agg(F.count(F.lit(1)).alias("kept"), F.count("out").alias("archived_posts_excluded"))
        windows = C.window_totals(self.measured, self.day_posts)
        fulltext = F.col("survey_year") >= FULLTEXT_FROM
        seen = F.when(F.col("survey_week") % 7 == 0, 0.8).otherwise(1.0)
        kept, out = F.coalesce("kept", F.lit(0)), F.coalesce("archived_posts_excluded", F.lit(0))
        total = F.coalesce("posts_in_window_all_sources", F.lit(0))
        built = self.measured.join(counts, "event_id", "left").join(windows, "event_id", "left").select(
            "event_id", "event_slug", "event_name", "survey_year", "survey_week", "attention_percentage",
            F.col("quote_examples").alias("quotes"),
            F.date_add("week_start", 20).alias("built_at"), "match_start", "match_end_exclusive",
            F.when(fulltext, "fulltext").otherwise("summary").alias("retriever"), F.lit("embed-1").alias("embed_model"),
            F.lit("rank-1").alias("rerank_model"), F.lit(3000).alias("rerank_candidates_requested"),
            F.when(fulltext, 0.5).when(F.col("survey_week") % 5 == 0, 0.3).otherwise(0.35).alias("rerank_threshold"),
            (kept * 2).alias("candidates_reranked"), kept.alias("matched_posts_reported"),
            out.alias("archived_posts_excluded"), (kept - out).alias("matched_posts_expected"),
            F.floor(total * seen).cast("long").alias("searchable_posts_in_window"), total.alias("posts_in_window_all_sources"))
        return cut_point(built, "datasets")

    @cached_property
    def empty_searches(self) -> DataFrame:
        return self.survey.filter((F.col("digit") <= 3) & (F.col("survey_week") % 4 == 0) & (F.col("survey_week") % 10 == 2)).select(
            "event_id", "event_slug", "event_name", "survey_year", "survey_week", F.lit(0).alias("kept"))

    # ------------------------------------------------------------------ marts
    @cached_property
    def messages(self) -> DataFrame:
        return cut_point(C.event_messages(self.matches, self.datasets, self.groups), "messages")

    @cached_property
    def by_day(self) -> DataFrame:
        return cut_point(C.message_days(self.messages), "by_day")

    @cached_property
    def sources(self) -> DataFrame:
        return cut_point(C.source_window(self.datasets, self.activity, self.groups, self.by_day), "sources")

    @cached_property
    def coverage(self) -> DataFrame:
        return cut_point(C.group_coverage(self.datasets, self.sources, self.messages, self.by_day), "coverage")

    @cached_property
    def daily(self) -> DataFrame:
        return C.group_daily(self.datasets, self.sources, self.by_day)

    @cached_property
    def overview(self) -> DataFrame:
        return cut_point(C.event_overview(self.datasets, self.sources, self.messages, self.by_day), "overview")

    @cached_property
    def resonance(self) -> DataFrame:
        return C.group_resonance(self.coverage, self.overview)

    @cached_property
    def gaps(self) -> DataFrame:
        return C.coverage_gaps(self.overview)

    @cached_property
    def detail(self) -> DataFrame:
        return C.message_detail(self.messages)

    # ------------------------------------------------------------------ themes
    @cached_property
    def themes(self) -> DataFrame:
        """Two-level taxonomy: a theme per priority digit, two umbrellas."""
        d = self.survey.select("digit").distinct()
        first = F.col("digit") <= 2
        return d.select(
            F.concat(F.lit("t"), F.col("digit")).alias("theme_id"), F.concat(F.lit("Theme "), F.col("digit")).alias("theme_label"),
            F.when(first, "u1").otherwise("u2").alias("umbrella_id"),
            F.when(first, "Umbrella one").otherwise("Umbrella two").alias("umbrella_label"),
            F.when(first, 1).otherwise(2).alias("umbrella_order"), F.col("digit").alias("theme_order"),
            (F.col("digit") == 5).alias("is_other_theme"))

    @cached_property
    def wording_themes(self) -> DataFrame:
        return self.survey.select("event_name", F.concat(F.lit("t"), F.col("digit")).alias("theme_id")).distinct()

    @cached_property
    def week_overrides(self) -> DataFrame:
        """Generic wordings that hold another subject in one week."""
        return self.survey.filter((F.col("survey_week") % 13 == 0) & (F.col("digit") == 1)).select(
            "survey_year", "survey_week", "event_name", F.lit("t3").alias("theme_id"))

    @cached_property
    def labels_en(self) -> DataFrame:
        return self.survey.filter(F.col("survey_week") % 3 == 1).select(
            "event_slug", F.concat(F.lit("Week "), F.col("survey_week"), F.lit(" "), F.lower("event_name")).alias("label_en"))

    @cached_property
    def themed(self) -> DataFrame:
        return TH.events_with_themes(self.survey, self.wording_themes, self.week_overrides, self.themes)

    @cached_property
    def week_events(self) -> DataFrame:
        return cut_point(TH.week_events(self.themed, self.overview, self.labels_en, self.empty_searches), "week_events")

    @cached_property
    def survey_weeks(self) -> DataFrame:
        return TH.survey_weeks(self.week_events)

    @cached_property
    def theme_attention(self) -> DataFrame:
        return TH.theme_week_attention(self.week_events, self.themes)

    @cached_property
    def theme_coverage(self) -> DataFrame:
        return cut_point(TH.theme_group_coverage(self.week_events, self.datasets, self.activity, self.groups, self.messages), "theme_coverage")

    # ------------------------------------------------------------------ texts and vocabulary
    @cached_property
    def texts(self) -> DataFrame:
        """Documents as posts: the language is the event; every second post is signed by its channel."""
        number = F.expr("substring(source, 4)").cast("int")
        signed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" read more | "), F.col("source"))).otherwise("")
        return self.table("documents").select(
            F.col("lang").alias("event_id"), F.concat("lang", F.when(F.col("lang").isin("en", "fr"), "_fulltext").otherwise("")).alias("event_slug"),
            F.concat(F.lit("g"), number % 5).alias("media_group"), F.col("source").alias("source_name"), F.col("doc_id").alias("message_id"),
            F.concat("text", signed).alias("post_text"))

    @cached_property
    def stopwords(self) -> DataFrame:
        return self.spark.range(1).select(F.explode(F.array(*map(F.lit, STOPWORDS))).alias("term"))

    @cached_property
    def split(self) -> DataFrame:
        return cut_point(V.split_texts(self.texts), "split_texts")

    @cached_property
    def tokens(self) -> DataFrame:
        return V.split_tokens(self.split)

    @cached_property
    def words(self) -> DataFrame:
        return cut_point(V.word_uses(self.split), "words")

    @cached_property
    def lexicon(self) -> DataFrame:
        words = self.words
        dictionary = words.select("word", F.regexp_replace("word", "s$", "").alias("lemma"))
        overrides = words.filter(F.length("word") == 4).select("word", F.substring("word", 1, 3).alias("lemma"))
        return cut_point(V.lexicon(words, self.stopwords, self.texts.select("source_name"), dictionary, overrides), "lexicon")

    @cached_property
    def common_words(self) -> DataFrame:
        return V.common_words(self.lexicon, self.words)

    @cached_property
    def word_posts(self) -> DataFrame:
        return cut_point(V.posts_with_words(self.texts, self.split, self.texts.select("source_name")), "word_posts")

    @cached_property
    def listed(self) -> DataFrame:
        return cut_point(V.listed_forms(self.split, self.lexicon, self.common_words), "forms")

    @cached_property
    def forms(self) -> DataFrame:
        return V.listed_rows(self.listed)

    @cached_property
    def terms(self) -> DataFrame:
        return V.post_terms(self.listed)

    @cached_property
    def source_terms(self) -> DataFrame:
        return cut_point(V.source_terms(self.word_posts, self.terms), "source_terms")

    @cached_property
    def kept_terms(self) -> DataFrame:
        return cut_point(V.term_scores(self.word_posts, self.source_terms), "kept_terms")

    @cached_property
    def kept_forms(self) -> DataFrame:
        """Spellings of surviving phrases; a word is shown as its dictionary form."""
        return cut_point(V.surviving_forms(V.phrase_forms(self.listed), self.kept_terms.filter("term_type = 'phrase'")), "kept_forms")

    @cached_property
    def term_posts(self) -> DataFrame:
        return cut_point(V.term_posts(self.word_posts, self.terms, self.kept_terms), "term_posts")

    @cached_property
    def term_labels(self) -> DataFrame:
        return V.term_labels(self.kept_terms, self.term_posts, self.kept_forms, self.source_terms)

    @cached_property
    def squeezed(self) -> DataFrame:
        month = F.concat(F.lit("2025-0"), (F.col("message_id") % 2 + 1).cast("string"))     # the documents have no dates
        return self.texts.select("source_name", month.alias("month"), "message_id", squeeze(F.col("post_text")).alias("t"))

    @cached_property
    def footers(self) -> DataFrame:
        return X.find_footers(self.squeezed, ["source_name", "month"], "t")

    # ------------------------------------------------------------------ candidates and labels
    @cached_property
    def candidates(self) -> DataFrame:
        """Documents as candidates of their language's event, scored by two scorers and labelled by several readers."""
        ident = F.col("doc_id")
        labels = self.table("labels").select("doc_id", "quality")
        base = self.table("documents").select("doc_id", "lang", F.length("text").alias("chars")).join(labels, "doc_id", "left")
        q = F.coalesce(F.col("quality"), F.lit(0))
        truth = F.col("quality") == 1

        def flipped(salt: str, share: float):
            return F.when(uniform(salt, ident) < share, ~truth).otherwise(truth)

        def blend(salt: str, own: float):
            return uniform(salt, ident) * own + q * (1 - own)

        d = base.select(
            F.col("lang").alias("event"), ident.alias("post_id"), "chars", (uniform("cos", ident) * 0.6 + q * 0.3).alias("cos"),
            blend("a", 0.7).alias("score_a"), blend("b", 0.8).alias("score_b"), uniform("c", ident).alias("score_c"), truth.alias("truth"),
            flipped("j2", 0.10).alias("judge2"), flipped("j3", 0.15).alias("judge3"),
            F.when(uniform("rd", ident) >= 0.05, flipped("r1", 0.08)).alias("reader"), flipped("r2", 0.20).alias("reader2"))
        ranked = rank_by_score(d, ["event"], "cos", "post_id", 0.0, 1.0)
        banded = ranked.withColumn("band", F.coalesce(RL.rank_band(F.col("rank"), RANK_EDGES), F.lit(len(RANK_EDGES) - 1)))
        weights = summary(banded.groupBy("event", "band").agg(
            (F.count(F.lit(1)).cast("double") / F.nullif(F.count("truth"), F.lit(0))).alias("_w")))
        full = banded.join(weights, ["event", "band"]).withColumn("weight", F.when(F.col("truth").isNotNull(), F.col("_w"))).drop("_w")
        return cut_point(full, "candidates")

    @cached_property
    def labelled(self) -> DataFrame:
        return self.candidates.filter(F.col("truth").isNotNull())

    # ------------------------------------------------------------------ vectors
    @cached_property
    def vectors(self) -> DataFrame:
        """Unit vectors as fragments of posts; every fourth vector starts a new post."""
        owner = F.floor(F.col("vec_id") / 4)
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), owner.alias("owner_id"), (owner % 3).cast("int").alias("window"), "label",
            RT.unit("embedding").alias("vector"))

    @cached_property
    def probes(self) -> DataFrame:
        """Each label's event asks with the three lowest vectors of the label."""
        first = Window.partitionBy("label").orderBy("id")
        return self.vectors.withColumn("rn", F.row_number().over(first)).filter("rn <= 3").select(
            F.col("label").alias("event_id"), (F.col("label") % 3).alias("window"), (F.col("rn") - 1).alias("probe"), F.col("vector").alias("probe_vector"))

    @cached_property
    def probe_scores(self) -> DataFrame:
        return cut_point(RT.probe_scores(self.vectors, self.probes, "window", "id", "vector"), "probe_scores")

    # ------------------------------------------------------------------ framing records
    @cached_property
    def all_records(self) -> DataFrame:
        """One framing record per document, its fields drawn from digests of the document id."""
        ident = F.col("doc_id").cast("string")

        def h(salt: str, n: int, *more):
            digest = F.md5(F.concat_ws("|", F.lit(salt), *[m.cast("string") for m in more], ident))
            return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n

        def pick(values: list[str], index):
            return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

        def several(n, build):
            return F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), n.cast("int")), build)

        g = F.expr("substring(source, 4)").cast("int") % 5
        statuses = ["asserted"] * 5 + ["attributed", "attributed", "hedged", "denied", "questioned"]
        quote = F.substring(F.col("text"), (h("q", 40) + 1).cast("int"), F.lit(40))
        broken = F.concat(F.substring(quote, 1, 10), F.lit(" zzz "), F.substring(quote, 16, 25))
        evidence = F.when(h("qq", 3) == 0, broken).otherwise(F.concat(F.lit("«"), F.replace(F.replace(quote, F.lit("t"), F.lit("ｔ")), F.lit("fi"), F.lit("ﬁ")), F.lit("»")))
        entity = several(h("ne", 3) + 1, lambda i: F.struct(
            F.concat(F.lit("m"), i).alias("mention"), F.concat(F.lit("actor"), h("en", 8, i)).alias("canonical"), pick(["person", "org", "place"], h("et", 3, i)).alias("type")))
        label = several(h("na", 4), lambda i: F.struct(
            F.concat(F.lit("act"), i).alias("action"), F.concat(F.lit("term"), h("at", 12, i)).alias("term"),
            pick(["positive", "negative", "neutral"], (h("av", 4, i) + g) % 3).alias("valence"), F.lit(None).cast("string").alias("evidence")))
        moral = several(h("nm", 4), lambda i: F.struct(
            F.concat(F.lit("actor"), h("me", 6, i)).alias("entity"), pick(FR.ROLES, (h("mr", 6, i) * 3 + g) % 18).alias("role"),
            F.when(h("mx", 10, i) != 0, (h("mp", 7, i) - 3).cast("int")).alias("polarity"), h("mi", 4, i).cast("int").alias("intensity"), F.lit(None).cast("string").alias("evidence")))
        first = F.regexp_extract("text", r"^[^.]*\.", 0)
        none = F.lit(None).cast("string")
        return self.table("documents").select(
            F.col("lang").alias("event"), F.col("doc_id").alias("message_id"), "source", F.concat(F.lit("g"), g).alias("media_group"),
            F.concat(F.lit("2025-03-"), F.lpad((h("dy", 28) + 1).cast("string"), 2, "0"), F.lit("T10:00:00")).alias("date"), uniform("a", ident).alias("rerank_score"),
            F.col("text").alias("text_used"), F.when(h("on", 20) > 0, h("on", 20) != 1).alias("on_event"), none.alias("on_event_evidence"),
            entity.alias("entities"), F.trim(first).alias("problem_definition"), evidence.alias("problem_definition_evidence"), label.alias("action_labels"),
            F.struct(F.when(h("cc", 3) != 0, F.concat(F.lit("actor"), h("ce", 8))).alias("cause_entity"), none.alias("mechanism"), none.alias("evidence")).alias("causal_attribution"),
            moral.alias("moral_evaluation"), F.when(h("tr", 3) != 0, F.trim(first)).alias("treatment"), pick(statuses, (h("ep", 10) + g) % 10).alias("epistemic_status"),
            F.substring("text", 1, 30).alias("epistemic_evidence"), F.array(F.concat(F.lit("theme"), h("em", 5))).alias("emphasized"),
            F.struct(*[(h("sem", 100, F.lit(i)) < 20 + 10 * i + 4 * g).alias(f) for i, f in enumerate(FR.FRAMES)]).alias("semetko"),
            F.concat(F.lit("n"), (h("nar", 10) + g) % 4).alias("narrative_id"))

    @cached_property
    def records(self) -> DataFrame:
        return cut_point(FR.on_event(self.all_records), "records")
