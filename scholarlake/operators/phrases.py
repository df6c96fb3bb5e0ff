"""Rules of phrases as tables, found by one automaton in one pass over a text.

A rule has a priority and phrases; a text is read once, however many phrases there are, and the rules that have one in it come
out. Intents of questions, canonical topics of labels, and what their texts then weigh, are such rules and look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Intents of questions in order of precedence and what tells them.
INTENTS = {
    "contribution": ("contribution", "contributions", "novelty", "novel", "innovation", "main contribution", "propose", "proposed", "创新", "贡献", "提出"),
    "paper_overview": ("summary", "summarize", "summarise", "overview", "overall", "main idea", "what is this paper about", "paper about", "概述", "总结", "梗概"),
    "method_flow": ("method", "methods", "approach", "framework", "architecture", "algorithm", "pipeline", "workflow", "model", "training", "inference", "方法", "流程", "框架", "模型", "算法"),
    "experiment_setup": ("experiment", "experiments", "evaluation", "dataset", "baseline", "benchmarks", "benchmark", "metric", "metrics", "setup", "setting", "split", "实验", "数据集", "评估", "基准"),
    "result_analysis": ("result", "results", "performance", "ablation", "analysis", "effect", "improve", "findings", "结果", "性能", "分析", "比较"),
    "comparison": ("compare", "comparison", "baseline", "ablation", "compared", "versus", "对比", "比较", "基线"),
    "dataset": ("dataset", "datasets", "corpus", "data", "benchmark", "split", "数据集", "数据", "语料"),
    "limitation": ("limitation", "limitations", "weakness", "future work", "failure", "constraint", "局限", "不足", "未来工作"),
    "definition": ("definition", "define", "what is", "meaning", "concept", "notation", "formulation", "problem setup", "定义", "概念", "是什么"),
    "implementation_detail": ("implementation", "hyperparameter", "hyperparameters", "prompt", "training detail", "training details", "optimizer", "batch size", "learning rate", "code", "cost", "实现", "训练细节", "参数"),
    "figure_table": ("figure", "fig.", "table", "chart", "diagram", "caption", "图", "表", "图表"),
}
SUB_INTENTS = {
    "paper_overview": ("overview", "summary", "contribution", "main", "high level"),
    "evidence_seeking": ("evidence", "supporting", "passage", "grounding", "support"),
    "result_check": ("result", "results", "performance", "metric", "score", "结果", "性能", "指标"),
    "table_lookup": ("table", "figure", "caption", "chart", "图", "表", "图表"),
    "deep_method": ("pipeline", "architecture", "training", "inference", "implementation", "流程", "架构", "训练", "推理"),
}
ROUTES = ("vector_original", "vector_rewrite", "vector_hyde", "keyword", "table_structured")
ROUTE_WEIGHTS = {
    "contribution": (1.15, 1.1, 0.9, 0.6, 0.6), "paper_overview": (1.15, 1.1, 0.9, 0.6, 0.6), "method_flow": (0.95, 1.15, 0.85, 1.0, 0.8), "experiment_setup": (0.9, 1.15, 0.8, 1.1, 1.05),
    "result_analysis": (0.88, 1.18, 0.82, 1.08, 1.2), "comparison": (0.85, 1.15, 0.8, 1.0, 1.18), "dataset": (0.9, 1.1, 0.8, 1.05, 1.08), "limitation": (0.85, 1.05, 0.8, 0.95, 0.75),
    "definition": (0.9, 1.05, 0.85, 1.0, 0.8), "implementation_detail": (0.95, 1.15, 0.85, 1.0, 0.78), "figure_table": (0.75, 0.95, 0.7, 1.2, 1.22), "other": (1.0, 0.9, 0.85, 0.75, 0.88),
}
#: What a sub-intent multiplies the weight of a route by.
SUB_FACTORS = {
    "paper_overview": {"vector_original": 1.08, "vector_rewrite": 1.05}, "evidence_seeking": {"vector_rewrite": 1.06, "keyword": 1.06}, "result_check": {"vector_rewrite": 1.07, "keyword": 1.08, "table_structured": 1.12},
    "table_lookup": {"keyword": 1.1, "table_structured": 1.18}, "deep_method": {"vector_rewrite": 1.05},
}
#: Canonical topics in order of precedence, by words of a label.
TOPICS = {
    "RAG retrieval optimization": ("retrieval-augmented generation", "retrieval augmented generation", "rag", "hybrid retrieval", "reranking", "rerank", "retrieval optimization"),
    "agent memory": ("agent memory", "llm memory", "llm long-term memory", "memory-augmented agent", "memory augmented agent", "memory-augmented agents", "memory augmented agents", "long-term memory for agents", "long horizon agent memory", "long-horizon agent memory", "graph-structured session memory", "session memory", "episodic memory"),
    "long-context reasoning": ("long-context", "long context", "context window", "long-range reasoning", "long horizon reasoning"),
    "LLM reasoning": ("llm reasoning", "language model reasoning", "chain-of-thought", "multi-step reasoning"),
    "tool-using agents": ("tool use", "tool-using", "tool using", "function calling", "api calling"),
    "knowledge graph construction": ("knowledge graph", "entity extraction", "relation extraction", "kg construction", "graph construction"),
    "multi-agent systems": ("multi-agent", "multi agent", "agent collaboration", "agent coordination"),
    "vision-language models": ("vision-language", "vision language", "multimodal", "image-text"),
    "diffusion models": ("diffusion model", "diffusion models", "text-to-image", "image generation"),
    "code generation": ("code generation", "program synthesis", "software engineering", "code repair"),
    "benchmark evaluation": ("benchmark", "evaluation", "leaderboard", "ablation"),
    "recommendation systems": ("recommendation", "recommender", "personalization", "ranking"),
    "alignment and preference learning": ("alignment", "preference learning", "rlhf", "reward model"),
    "question answering": ("question answering", "qa", "reading comprehension"),
}
LOW_INFORMATION = ("analysis", "approach", "framework", "method", "methods", "model", "models", "paper", "papers", "system", "systems")
LABEL_STOPWORDS = ("a", "an", "and", "are", "as", "at", "based", "by", "for", "from", "in", "into", "is", "of", "on", "or", "over", "paper", "study", "the", "this", "to", "towards", "toward", "using", "via", "with")
TITLE_JOINERS = ("for", "with", "of", "using", "via", "towards", "toward", "based")
FIELD_WEIGHTS = {"body": 1.0, "title": 1.35, "section_title": 1.2, "section_path": 0.85, "summary": 0.95, "question": 0.9, "table_or_figure": 1.05, "asset_caption": 0.18, "asset_aux": 0.08}


@dataclass(frozen=True)
class Rules:
    """Names in order of precedence and their phrases, lower case. Whole words may end in s or es; else a phrase may stand anywhere."""

    phrases: tuple[tuple[str, tuple[str, ...]], ...]
    words: bool = False

    @classmethod
    def of(cls, table: dict[str, tuple[str, ...]], words: bool = False) -> Rules:
        return cls(tuple(table.items()), words)


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


@lru_cache(16)
def _automaton(rules: Rules) -> ahocorasick.Automaton:
    found: dict[str, tuple[int, ...]] = {}
    for i, (_, phrases) in enumerate(rules.phrases):
        for p in phrases:
            found[p] = (*found.get(p, ()), i)
    a = ahocorasick.Automaton()
    for p, which in found.items():
        a.add_word(p, (len(p), which))
    a.make_automaton()
    return a


def places(text: str, rules: Rules) -> list[int]:
    """The numbers of the rules that a text has a phrase of, in order."""
    out: set[int] = set()
    for end, (n, which) in _automaton(rules).iter(text):
        if rules.words:
            start, after = end - n + 1, end + 1
            if start and _inner(text[start - 1]):
                continue
            if not any(text.startswith(s, after) and not _inner(text[after + len(s) : after + len(s) + 1] or " ") for s in ("", "s", "es")):
                continue
        out.update(which)
    return sorted(out)


def matched(text: Column, rules: Rules) -> Column:
    """The names of the rules that a text has a phrase of, in order of precedence; none for null. Each text is read once."""

    @pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: places(t, rules) if t else [])

    names = F.array(*[F.lit(n) for n, _ in rules.phrases])
    return F.transform(F.coalesce(find(text), F.array().cast("array<int>")), lambda i: F.get(names, i))


def label_text(label: Column) -> Column:
    """A label as topics are looked for in it: lower case, _ and / as spaces, any dashes as one."""
    low = F.translate(F.lower(F.coalesce(label, F.lit(""))), "_/", "  ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[-\x{2010}-\x{2015}]+", "-"), r"\s+", " "))


def topic(label: Column) -> Column:
    """The canonical topic of a label, the first that has a phrase in it; null if none has."""
    return F.get(matched(label_text(label), Rules.of(TOPICS, words=True)), 0)


def label_kind(label: Column) -> Column:
    """What a label is if it names no topic: url, id, category, title, low_information, ngram, empty; null if it is one."""
    t = F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " "))
    words = F.filter(F.split(t, " "), lambda w: w != "")
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[.,:;!?()\[\]{}]+|[.,:;!?()\[\]{}]+$", "")))
    tokens = F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z][A-Za-z0-9+-]*"), F.lit(0)), lambda w: F.lower(w))
    stop = lambda w: w.isin(list(LABEL_STOPWORDS))
    joined = (F.size(words) >= 4) & (F.size(F.array_intersect(bare, F.array(*map(F.lit, TITLE_JOINERS)))) > 0)
    title = (F.length(t) > 60) | (F.size(words) > 6) | joined | t.rlike("[:?!]| -- | - ")
    ngram = (F.size(tokens) >= 2) & (F.coalesce(stop(F.get(tokens, 0)) | stop(F.get(tokens, F.size(tokens) - 1)), F.lit(False)) | ((F.size(tokens) >= 4) & (F.size(F.filter(tokens, stop)) >= 2)))
    category = t.rlike(r"^[a-z-]+(?:\.[A-Z]{2})?$") & (t.contains(".") | t.startswith("cs."))
    return (
        F.when(t == "", "empty").when(t.rlike(r"(?i)https?://|www\."), "url").when(t.rlike(r"^(?:\d{4}\.\d{4,5}(?:v\d+)?|[a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)$"), "id")
        .when(category | F.lower(t).startswith("cs."), "category").when(title, "title").when(F.lower(t).isin(list(LOW_INFORMATION)), "low_information").when(ngram, "ngram")
    )


def main_intent(question: Column) -> Column:
    """The first intent that a question tells, else other."""
    return F.coalesce(F.get(matched(_asked(question), Rules.of(INTENTS)), 0), F.lit("other"))


def _asked(question: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " ")))


def sub_intents(question: Column, main: Column) -> Column:
    """Up to three sub-intents that a question tells, in order; if none the one that goes with its main intent."""
    found = F.slice(matched(_asked(question), Rules.of(SUB_INTENTS)), 1, 3)
    usual = F.when(main.isin("paper_overview", "contribution", "comparison", "result_analysis"), "paper_overview").when(main == "figure_table", "table_lookup").otherwise("evidence_seeking")
    return F.when(F.size(found) > 0, found).otherwise(F.array(usual))


def route_weights(main: Column, subs: Column) -> list[Column]:
    """The weight of each of ROUTES for a question's intents, to three places."""
    by = F.create_map(*[x for k, w in ROUTE_WEIGHTS.items() for x in (F.lit(k), F.array(*map(F.lit, w)))])
    out = []
    for i, route in enumerate(ROUTES):
        weight = F.get(F.try_element_at(by, main), i)
        for sub, factors in SUB_FACTORS.items():
            if route in factors:
                weight = weight * F.when(F.array_contains(subs, sub), factors[route]).otherwise(1.0)
        out.append(F.round(weight, 3).alias(route))
    return out


def field_weights(main: Column, chunk_type: Column, index_weight: Column) -> list[Column]:
    """The weight of each field of FIELD_WEIGHTS: figures and tables count for questions about them only, and so do their captions; all times the index row's own weight."""
    asset = F.lower(F.trim(F.coalesce(chunk_type, F.lit("text")))).isin("figure", "table")
    about = F.coalesce(main == "figure_table", F.lit(False))
    lowered = {"body": 0.38, "section_title": 0.35, "section_path": 0.25, "asset_caption": 0.08, "asset_aux": 0.03}
    asked, unasked = {"asset_caption": 1.15, "asset_aux": 0.72}, {"asset_caption": 0.12, "asset_aux": 0.05}
    out = []
    for name, w in FIELD_WEIGHTS.items():
        other = min(w, unasked.get(name, w))
        value = F.when(about, asked.get(name, w)).when(asset, min(other, lowered.get(name, other))).otherwise(other)
        out.append(F.round(value * F.coalesce(F.nullif(index_weight, F.lit(0.0)), F.lit(1.0)), 6).alias(name))
    return out
