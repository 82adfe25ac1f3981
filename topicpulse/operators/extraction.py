"""Extraction stages: prompt rows out, response rows in; the model call is the user's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicpulse import dims
from topicpulse.functions import scalars as S
from topicpulse.operators import classify as C
from topicpulse.operators import library
from topicpulse.operators.relations import article_comments, comment_digest

_OPEN = "\x02"

# The extraction prompts.
ARTICLE_PROMPT = """你是一位资深的职场需求分析师。请从以下文章中提取核心职场问题和需求。

文章标题: {title}
来源平台: {platform}
文章内容:
{content}

请按以下要求提取需求：
1. 识别文章中反映的核心职场问题或需求
2. 每个需求包含以下字段：
   - title: 需求标题（不超过30个字符）
   - description: 需求描述（2-3句话概括该需求的具体表现和影响）
   - category: 从以下9个类别中选择一个：沟通协作、职业发展、求职面试、团队管理、职场情绪、职场关系、工作效率、薪酬福利、行业洞察
   - subcategory: 所属子类别
   - tags: 1-3个标签，用于进一步描述该需求的关键特征
   - importance_score: 重要性评分（0-10），根据需求的普遍性和紧迫性评估
3. 同时提供文章的简要摘要

输出语言: {language}

请严格按照以下JSON格式输出：
{{
  "demands": [
    {{
      "title": "需求标题",
      "description": "需求描述",
      "category": "类别",
      "subcategory": "子类别",
      "tags": ["标签1", "标签2"],
      "importance_score": 8
    }}
  ],
  "article_summary": "文章摘要"
}}
"""
COMMENT_PROMPT = """你是一位用户洞察分析师。请从以下评论中提取职场需求。

注意：评论往往比文章更直接地反映用户的真实痛点和需求，请特别关注：
- 用户抱怨或吐槽的问题
- 用户寻求帮助或建议的内容
- 用户分享的亲身经历中暴露的需求
- 引发大量共鸣（点赞/回复）的话题

评论内容:
{comments}

请按以下要求提取需求：
1. 每个需求包含以下字段：
   - title: 需求标题（不超过30个字符）
   - description: 需求描述（2-3句话概括该需求的具体表现和影响）
   - category: 从以下9个类别中选择一个：沟通协作、职业发展、求职面试、团队管理、职场情绪、职场关系、工作效率、薪酬福利、行业洞察
   - subcategory: 所属子类别
   - tags: 1-3个标签
   - importance_score: 重要性评分（0-10）
2. 同时提供评论的整体摘要

请严格按照以下JSON格式输出：
{{
  "demands": [
    {{
      "title": "需求标题",
      "description": "需求描述",
      "category": "类别",
      "subcategory": "子类别",
      "tags": ["标签1", "标签2"],
      "importance_score": 8
    }}
  ],
  "article_summary": "评论整体摘要"
}}
"""


def render(template: Column | str, **values: Column) -> Column:
    """Fill ``{name}`` placeholders; unknown ones stay, doubled braces become single.

    The template is cut at its placeholders first, so braces inside a value are
    never taken for a placeholder.
    """
    names = list(values)
    t = F.lit(template) if isinstance(template, str) else template
    t = F.replace(t, F.lit("{{"), F.lit(_OPEN))
    marked = reduce(
        lambda acc, i: F.replace(acc, F.lit("{" + names[i] + "}"), F.lit(f"\x01{i}\x01")), range(len(names)), t
    )
    unescaped = F.replace(F.replace(marked, F.lit("}}"), F.lit("}")), F.lit(_OPEN), F.lit("{"))
    if not names:
        return unescaped
    table = F.array(*[F.coalesce(values[n].cast("string"), F.lit("")) for n in names])
    pieces = F.split(unescaped, "\x01")
    # Odd pieces are placeholder numbers.
    filled = F.transform(
        pieces, lambda p, i: F.when(i % 2 == 1, F.get(table, p.cast("int"))).otherwise(p)
    )
    return F.array_join(filled, "")


def budget_cutoff(articles: DataFrame, comments: DataFrame, budget: int = 100) -> DataFrame:
    """Articles a day's call budget admits, newest first, with ``ask_comments``.

    An article costs one call, and one more when it has pending comments and the
    budget is not used up. Every article costs at least one call, so only the newest
    ``budget`` of a day can be admitted: the rank filter prunes before any shuffle.
    """
    day = F.to_date("crawl_time")
    newest = W.partitionBy("_day").orderBy(F.desc("crawl_time"), F.col("id"))
    top = articles.withColumn("_day", day).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= budget)
    waiting = comments.where(~F.col("is_analyzed")).select(F.col("article_id").alias("id")).distinct()
    rows = top.join(waiting.withColumn("_has", F.lit(True)), "id", "left")
    has = F.coalesce("_has", F.lit(False))
    before = F.sum(1 + has.cast("int")).over(newest.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("calls_before", F.coalesce(before, F.lit(0)))
    rows = rows.where(F.col("calls_before") < budget)
    return rows.withColumn("ask_comments", has & (F.col("calls_before") + 1 < budget)).drop("_day", "_r", "_has")


def article_requests(articles: DataFrame) -> DataFrame:
    prompt = render(
        ARTICLE_PROMPT,
        title=F.col("title"),
        platform=F.col("platform"),
        content=F.coalesce("content", F.lit("")),
        language=F.coalesce("language", F.lit("zh")),
    )
    return articles.select(F.col("id").alias("article_id"), prompt.alias("prompt"))


def comment_requests(articles: DataFrame, comments: DataFrame) -> DataFrame:
    """One request per article with waiting comments."""
    digest = comment_digest(article_comments(articles, comments))
    return digest.select("article_id", render(COMMENT_PROMPT, comments=F.col("comments")).alias("prompt"))


def _json_object(response: Column) -> Column:
    """The candidate JSON text: first fenced block, then from the first brace on."""
    text = F.regexp_replace(response, r"(?U)\A\s+|\s+\z", "")
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    inner = F.when(text.rlike(r"(?s)```(?:json)?\s*\n?.*?```"), F.regexp_replace(fenced, r"(?U)\A\s+|\s+\z", "")).otherwise(text)
    return S.bind(inner, lambda t: F.when(F.instr(t, "{") > 0, F.substring(t, F.instr(t, "{"), F.length(t))))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row, however often it is used.

    Spark copies formulas to where they are used, but not through a generator.
    """
    return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def parse_response(responses: DataFrame) -> DataFrame:
    """Add ``body`` (VARIANT) or the ``failure`` reason of each response."""
    found = responses.withColumn("_json", _json_object(F.col("response")))
    # A lenient parser stops after the first object; a strict one wants nothing behind it. Inside
    # an object of our own, whatever follows breaks the object or shows as another key.
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), F.col("_json"), F.lit(',"end":1}')))
    fields = F.map_keys(F.try_variant_get("_whole", "$", "map<string,variant>"))
    alone = F.array_sort(fields) == F.array(F.lit("end"), F.lit("v"))
    body = F.when(alone, F.try_variant_get("_whole", "$.v", "variant"))
    failure = F.when(F.col("_json").isNull(), "no object").when(F.col("body").isNull(), "bad json")
    parsed = _once(_once(found, "_whole", whole), "body", body)
    return parsed.withColumn("failure", failure).drop("_json", "_whole")


def _get(row: Column, name: str) -> Column:
    return F.try_variant_get(row, f"$.{name}", "string")


def _untitled(d: Column) -> Column:
    return F.coalesce(_get(d, "title"), F.lit("")) == ""


def _unreadable_score(d: Column) -> Column:
    """A score that is there (a JSON null is) but is no number; an absent one counts as zero."""
    there = F.try_variant_get(d, "$.importance_score", "variant").isNotNull()
    return there & _get(d, "importance_score").try_cast("double").isNull()


def validate_demands(parsed: DataFrame) -> DataFrame:
    """Explode the demands of a response, normalise them, flag unknown categories.

    One demand without a title or with an unreadable score fails its whole response;
    that is decided inside the row, before the list is exploded.
    """
    items = F.try_variant_get("body", "$.demands", "array<variant>")
    whole = ~F.exists("_items", lambda d: _untitled(d) | _unreadable_score(d))
    rows = _once(parsed.where("failure IS NULL"), "_items", items).where(whole)
    rows = rows.select("article_id", F.posexplode("_items").alias("pos", "d"))
    d = F.col("d")
    tag_list = F.try_variant_get(d, "$.tags", "array<string>")
    category = _get(d, "category")
    return rows.select(
        "article_id",
        F.col("pos").cast("bigint").alias("pos"),
        _get(d, "title").alias("title"),
        F.coalesce(_get(d, "description"), F.lit("")).alias("description"),
        category.alias("category"),
        _get(d, "subcategory").alias("subcategory"),
        F.coalesce(tag_list, S.comma_list(_get(d, "tags")), F.array().cast("array<string>")).alias("tags"),
        S.clamp_score(F.coalesce(_get(d, "importance_score").try_cast("double"), F.lit(0.0))).alias("importance_score"),
        ((F.coalesce(category, F.lit("")) != "") & ~F.col("d").isNull() & ~F.coalesce(category, F.lit("")).isin(dims.VALID_CATEGORIES)).alias("unknown_category"),
    )


def failed_responses(parsed: DataFrame) -> DataFrame:
    """Responses that yield nothing, with the reason."""
    items = F.try_variant_get("body", "$.demands", "array<variant>")
    wrong = F.when(F.exists("_items", _untitled), "demand without title").when(F.exists("_items", _unreadable_score), "unreadable score")
    reason = F.coalesce("failure", wrong)
    listed = _once(parsed, "_items", items)
    return listed.withColumn("failure", reason).where("failure IS NOT NULL").drop("body", "_items")


def demand_rows(validated: DataFrame, seen: Column) -> DataFrame:
    """Library rows of extracted demands: JSON tags, defaults, a key-derived id."""
    return validated.select(
        F.xxhash64("article_id", "pos", "title").alias("id"),
        "article_id",
        "pos",
        "title",
        "description",
        "category",
        "subcategory",
        F.to_json("tags").alias("tags"),
        F.lit(1).cast("bigint").alias("frequency"),
        "importance_score",
        F.lit("stable").alias("trend"),
        F.lit("new").alias("status"),
        F.lit("zh").alias("language"),
        seen.alias("first_seen"),
        seen.alias("last_seen"),
    )


def link_rows(rows: DataFrame) -> DataFrame:
    """Article links of demands extracted from articles (not from comments)."""
    return rows.select(
        "article_id",
        F.col("id").alias("demand_id"),
        F.col("importance_score").alias("relevance_score"),
        S.text_prefix(F.coalesce("description", F.lit(""))).alias("context_snippet"),
    )


def dedup_decisions(responses: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Judge responses; the verdict follows from the score."""
    p = parse_response(responses)
    score = F.coalesce(_get(F.col("body"), "similarity_score").try_cast("double"), F.lit(0.0))
    return p.select(
        *[c for c in responses.columns if c != "response"],
        (score >= threshold).alias("is_same"),
        score.alias("similarity_score"),
        _get(F.col("body"), "merged_title").alias("merged_title"),
        _get(F.col("body"), "merged_description").alias("merged_description"),
    )


def reclassify_decisions(rows: DataFrame) -> DataFrame:
    """Category and subcategory of a classification response, else by keywords.

    The answer must be one JSON object as it stands; anything else falls back.
    """
    text = F.trim("response")
    plain = F.when(text.startswith("{") & text.endswith("}"), F.try_parse_json(text))
    r = rows.withColumn("_r", plain).withColumn("_k", C.classify(F.col("title"), F.col("description")))
    answered = F.col("_r").isNotNull()
    category = library.valid_category(F.coalesce(_get(F.col("_r"), "category"), F.lit("")))
    sub = F.coalesce(_get(F.col("_r"), "subcategory"), F.lit(dims.FALLBACK_SUBCATEGORY))
    return r.select(
        *[c for c in rows.columns if c != "response"],
        F.when(answered, category).otherwise(F.col("_k.category")).alias("category"),
        F.when(answered, sub).otherwise(F.col("_k.subcategory")).alias("subcategory"),
    )


def candidate_payloads(candidates: DataFrame, library_rows: DataFrame) -> DataFrame:
    """Per new title, its candidates as one JSON array for an outside judge.

    ``candidates`` holds at most a fixed number of rows per ``query_id``.
    """
    names = library_rows.select(
        F.col("id").alias("candidate_id"), "title", F.coalesce("description", F.lit("")).alias("description")
    )
    item = F.struct(F.col("rank"), F.struct(F.col("candidate_id").alias("id"), "title", "description").alias("c"))
    grouped = candidates.join(names, "candidate_id").groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return grouped.select("query_id", F.to_json(F.col("x.c")).alias("candidates"))
