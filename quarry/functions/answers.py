"""Answers and what they must cover: clean-up, requirements, gates of reviews, and arithmetic that a question asks for."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import words as W
from .profiles import answer_policy, has_any, last_question, let, literal_array, requirement_parts, trim_marks
from .text import distinct_strings, strip, text


def cleaned_answer(value: Column) -> Column:
    """Without phrases that announce what never came, doubled stops, white space before line ends and more than one blank line."""
    out = strip(text(value))
    for phrase in W.UNFINISHED:
        out = F.regexp_replace(out, r"[，,、]?\s*" + phrase, "。")
    for pattern, instead in (
        ("仅提到[“\"]?[。；，、][”\"]?这一概括性表述", "仅提到概括性表述"), ("[“\"]?[。；，、][”\"]?这一概括性表述", "概括性表述"),
        ("。{2,}", "。"), (r"[，,、]\s*。", "。"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"),
    ):
        out = F.regexp_replace(out, pattern, instead)
    return strip(out)


def asks_current_role(query: Column) -> Column:
    """Whether a question for who holds an office means now."""
    return let(strip(text(query)), lambda q: ~has_any(q, W.PAST_ROLES) & has_any(q, ("谁", "哪位")) & has_any(F.lower(q), W.CURRENT_ROLES))


def asks_time(query: Column) -> Column:
    dated = lambda q: q.rlike(r"(?:19|20)\d{2}") | q.rlike(r"\d{1,2}\s*月\s*\d{1,2}\s*[日号]")
    return let(last_question(query), lambda q: (q != "") & (has_any(q, W.ANSWER_TIMES) | dated(q) | asks_current_role(q)))


def comparative_points(query: Column) -> Column:
    """What a comparison must cover; nothing for other questions."""
    return let(trim_marks(strip(text(query))), _points)


def _points(q: Column) -> Column:
    alike = F.contains(q, F.lit("相似")) & has_any(q, ("之处", "点", "特征", "特点"))
    common = F.contains(q, F.lit("共同")) & has_any(q, ("目标", "点", "特征", "特点"))
    own = has_any(q, ("独特特点", "各自特点", "特点", "特征", "区别", "不同"))
    points = F.array(F.when(alike, "比较对象的相似之处或共同点"), F.when(common, "比较对象的共同目标或共同点"), F.when(own, "比较对象各自的独特特点或区别"))
    return F.when(answer_policy(q)["comparative"], F.filter(points, lambda x: x.isNotNull())).otherwise(literal_array(()))


def numbered_steps(contents: Column) -> Column:
    """Whether texts (an array) have two numbered lines or more together."""
    lines = F.flatten(F.transform(contents, lambda t: F.split(text(t), "\n")))
    return F.size(F.filter(lines, lambda x: strip(x).rlike(r"^\d+[.、]"))) >= 2


def coverage_requirements(query: Column, has_series: Column, has_text: Column, contents: Column) -> Column:
    """What an answer must cover, as a list under a title; empty without any."""
    steps = numbered_steps(contents)
    return let(F.struct(last_question(query).alias("q"), answer_policy(query).alias("p")), lambda x: _coverage(x["q"], x["p"], has_series, has_text, steps))


def _coverage(q: Column, policy: Column, has_series: Column, has_text: Column, numbered: Column) -> Column:
    lines = let(requirement_parts(q), lambda own: F.when(F.size(own) > 1, own).otherwise(comparative_points(q)))
    series = F.array(
        F.lit("时间范围与主要变化趋势"), F.when(has_any(q, W.ANOMALIES), "关键异常点或峰值谷值"),
        F.when(has_text & has_any(q, W.WHY), "对应事件背景或文本原因说明"),
    )
    steps = F.array(F.lit("完整覆盖上下文中已经给出的操作步骤"), F.lit("不要遗漏后续编号步骤、注意事项或取下部件清单"))
    more = F.concat(F.when(has_series, series).otherwise(literal_array(())), F.when(policy["procedural"] & numbered, steps).otherwise(literal_array(())))
    every = F.array_distinct(F.filter(F.concat(lines, more), lambda x: x.isNotNull()))
    return let(every, lambda e: F.when((q == "") | (F.size(e) == 0), "").otherwise(F.concat(F.lit("【回答覆盖要求】\n- "), F.array_join(e, "\n- "), F.lit("\n\n"))))


def answer_requirements(query: Column, has_series: Column, has_text: Column, contents: Column) -> Column:
    """What form an answer must have, as a list under a title; empty without any."""
    steps, timed = numbered_steps(contents), asks_time(query)
    return let(F.struct(last_question(query).alias("q"), answer_policy(query).alias("p")), lambda x: _form(x["q"], x["p"], timed, steps, has_series & has_text))


def _form(q: Column, p: Column, timed: Column, numbered: Column, both: Column) -> Column:
    lines = F.array(
        F.when(p["direct"], "第一句先直接给出结论，再补充必要说明。"),
        F.when(p["comparative"], "若涉及多个对象，必须逐项对照说明，不得只给笼统总结。"),
        F.when(timed, "回答中必须保留具体时间点、年份或日期，不要弱化时间条件。"),
        F.when(p["procedural"], "若上下文包含编号步骤，必须按原编号顺序完整列出，不得擅自截断或合并后续步骤。"),
        F.when(p["procedural"], "不要写“上下文未完整列出”“具体内容略”等保守性说明，除非证据确实缺失。"),
        F.when(p["procedural"] & numbered, "优先保留原文中的部件名、螺栓规格、数量和提示信息，不要只做笼统概括。"),
        F.when(both, "若同时存在时间序列证据与文本证据，回答需分别覆盖趋势观察与事件背景。"),
    )
    kept = F.filter(lines, lambda x: x.isNotNull())
    return F.when((q == "") | (F.size(kept) == 0), "").otherwise(F.concat(F.lit("【回答形式要求】\n- "), F.array_join(kept, "\n- "), F.lit("\n\n")))


def uses_image_prompt(query: Column, groups: Column) -> Column:
    """Whether references of these groups (an array of ocr, vision, text and timeseries) call for the prompt for images."""
    asked = has_any(F.lower(strip(text(query))), W.IMAGE)
    images = F.size(F.filter(groups, lambda g: g.isin("ocr", "vision")))
    others = F.size(groups) - images
    return (asked & ((images > 0) | (F.size(groups) == 0))) | ((images > 0) & (others == 0)) | ((images >= 2) & (images >= others))


def needs_joint_coverage(query: Column, groups: Column) -> Column:
    return F.array_contains(groups, "timeseries") & F.array_contains(groups, "text") & has_any(last_question(query), W.WHY)


def reviews(query: Column, groups: Column, draft: Column, coverage: Column) -> Column:
    """struct of completeness, factual and retry: which reviews a draft of an answer goes through."""
    ready = (F.size(groups) > 0) & ~uses_image_prompt(query, groups) & (strip(text(draft)) != "")
    joint = needs_joint_coverage(query, groups)
    complete = (strip(text(coverage)) != "") | joint | has_any(text(query), W.CHECKLIST) | answer_policy(query)["procedural"]
    covered = has_any(text(draft), W.OBSERVED) & has_any(text(draft), W.EXPLAINED)
    return F.struct((ready & complete).alias("completeness"), ready.alias("factual"), (joint & ~covered).alias("retry"))


# arithmetic


def math_expression(query: Column) -> Column:
    """The longest run of digits and operators that has a digit and an operator between operands; empty without one."""
    plain = F.translate(text(query), "×xX÷（）", "***/()")
    runs = F.regexp_extract_all(plain, F.lit(r"[\d.+\-*/%()\s]{3,}"), F.lit(0))
    tidy = F.filter(F.transform(runs, lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x.rlike(r"\d") & x.rlike(r"\d\)*[+\-*/%]+\(*\d"))
    longest = F.array_max(F.transform(tidy, lambda x: F.length(x)))
    return F.coalesce(F.try_element_at(F.filter(tidy, lambda x: F.length(x) == longest), F.lit(1)), F.lit(""))


def numbers_for(query: Column, contents: Column) -> Column:
    """Distinct numbers of texts: those soon after an identifier of the question, then, if there are fewer than two, all."""
    whole = F.array_join(contents, "\n")
    terms = distinct_strings(F.regexp_extract_all(text(query), F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b"), F.lit(0)))
    near = F.flatten(F.transform(terms, lambda t: F.regexp_extract_all(whole, F.concat(F.lit(r"(?i)\Q"), t, F.lit(r"\E[^\d\-]{0,20}(-?\d+(?:\.\d+)?)")), F.lit(1))))
    every = F.regexp_extract_all(whole, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.array_distinct(F.when(F.size(near) >= 2, near).otherwise(F.concat(near, every)))


def derived_expression(query: Column, contents: Column) -> Column:
    """The question's own expression, else one over numbers of texts by the operation it names; empty with fewer than two."""
    own, n, q = math_expression(query), numbers_for(query, contents), text(query)
    two = lambda sign: F.concat(n[0], F.lit(sign), n[1])
    made = (
        F.when(has_any(q, W.AVERAGE), F.concat(F.lit("("), F.array_join(n, "+"), F.lit(")/"), F.size(n).cast("string")))
        .when(has_any(q, W.MULTIPLY), two("*")).when(has_any(q, W.DIVIDE), two("/")).when(has_any(q, W.SUBTRACT), two("-")).otherwise(two("+"))
    )
    return F.when(own != "", own).when(F.size(n) >= 2, made).otherwise("")


# fixed value: the longest expression that is worked out; powers are bounded, as digits of a result are
EXPRESSION_CHARS, POWER_BITS = 120, 10_000


def _power(a, b):
    if abs(b) * max(1, abs(int(a)).bit_length()) > POWER_BITS:
        raise OverflowError("power too large")
    return a**b


_TWO = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: _power}
_ONE = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def calculate(expression: str | None) -> str | None:
    """An expression and its value; null where it isn't plain arithmetic, too long, or has no value."""
    expression = (expression or "").strip()

    def value(node):
        match node:
            case ast.Constant(value=int() | float() as n) if not isinstance(n, bool):
                return n
            case ast.UnaryOp(op=op, operand=x) if type(op) in _ONE:
                return _ONE[type(op)](value(x))
            case ast.BinOp(left=x, op=op, right=y) if type(op) in _TWO:
                return _TWO[type(op)](value(x), value(y))
        raise ValueError("not plain arithmetic")

    if not 0 < len(expression) <= EXPRESSION_CHARS:
        return None
    try:
        found = value(ast.parse(expression, mode="eval").body)
        return f"{expression} = {int(found) if isinstance(found, float) and found.is_integer() else found}"
    except (ValueError, SyntaxError, ArithmeticError, RecursionError, TypeError):
        return None


@F.pandas_udf(StringType())
def calculated(expressions: pd.Series) -> pd.Series:
    return expressions.map(calculate)
