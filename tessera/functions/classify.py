"""Rule-based classes of questions, lines, commands and log rows: the first rule that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What asks for each intent, what tells of each status and kind of check; in order.
POSITION = r"đang làm gì|làm tới đâu|dừng ở đâu|dở ở đâu|stopped where|working on|current task|file nào|last touched|làm gì tiếp|next action|next step"
INTENTS = [
    ("previous_agent", r"agent trước là ai|previous agent|ai trước là ai|phiên trước là ai"),
    ("current_task", r"task hiện tại|current task|đang làm gì|đang làm task nào|dở ở đâu|dừng ở đâu|stopped where"),
    ("next_action", r"tiếp theo|next action|next step|làm gì tiếp|phải làm gì tiếp"),
    ("last_file", r"file cuối|last file|file nào|đang sửa file|last touched"),
    ("blocker", r"blocker|vướng|kẹt|lỗi gì|blocked"),
    ("decision", r"decision|quyết định|đã chốt|important decision"),
    ("completed", r"đã xong|completed|hoàn thành|done|todo nào xong"),
    ("status", r"status|trạng thái|tiến độ|progress"),
]
STATUS = [
    ("cancelled", r"\b(cancelled|canceled)\b|đã hủy|bỏ qua"),
    ("blocked", r"\b(blocked|blocker)\b|đang vướng|bị vướng|đang kẹt|chưa thể"),
    ("completed", r"\b(completed|complete|done|finished|passed)\b|hoàn thành|hoàn tất|đã xong|đã làm xong|\bxong\b"),
    ("in_progress", r"\bin[\s_-]*progress\b|working on|đang làm|đang thực hiện|đang xử lý|đang triển khai"),
]
CHECK_KIND = [
    ("typecheck", r"\b(typecheck|type-check)\b|\btsc\b[\s\S]*--noemit\b"),
    ("lint", r"\b(eslint|lint)\b"),
    ("test", r"\b(vitest|jest|pytest)\b|\bgo\s+test\b|\bcargo\s+test\b|\b(npm|pnpm|yarn)\s+(run\s+)?test\b"),
    ("build", r"\b(npm|pnpm|yarn)\s+(run\s+)?build\b|\bcargo\s+build\b|\bgo\s+build\b|\btsc\b"),
]


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(F.lit(default))


def intent(question: Column) -> Column:
    q = F.lower(F.trim(F.regexp_replace(question, r"\s+", " ")))
    both = q.rlike("agent trước|previous agent|ai trước|phiên trước") & q.rlike(POSITION)
    return F.when(both, "summary").otherwise(first_match(q, INTENTS, "summary"))


def status_of(text: Column) -> Column:
    return first_match(F.lower(text), STATUS, "pending")


def check_kind(command: Column) -> Column:
    return first_match(F.lower(command), CHECK_KIND)


def check_status(exit_code: Column, output: Column) -> Column:
    """The exit code decides, else the words of the output."""
    low = F.lower(output)
    by_text = (
        F.when(low.rlike(r"\b(error|failed|failure|failing)\b") & ~low.rlike(r"\b0\s+failed\b"), "failed").when(low.rlike(r"\b(success|successful|completed|passed|green)\b"), "passed")
        .when(low.rlike(r"\b(running|started|in[_ -]?progress)\b"), "running").otherwise("unknown")
    )
    return F.when(exit_code.isNotNull(), F.when(exit_code == 0, "passed").otherwise("failed")).otherwise(by_text)


def log_row_type(outer: Column, payload: Column, role: Column) -> Column:
    """The type of a rollout row. A call's output counts as a call, since names of calls are looked for first."""
    outer, payload, role = (F.lower(F.coalesce(c, F.lit(""))) for c in (outer, payload, role))
    has = lambda c, *words: c.rlike("|".join(words))
    return (
        F.when(outer == "session_meta", "custom").when((role == "user") | (payload == "user_message"), "user_prompt").when((role == "assistant") | payload.isin("agent_message", "assistant_message"), "assistant_message")
        .when(has(payload, "function_call", "tool_call", "exec_command_begin", "exec_command_start"), "tool_call").when(has(payload, "tool_result", "exec_command_end", "exec_command_complete"), "tool_result")
        .when(has(payload, "error"), "error").when(has(outer, "compacted") | has(payload, "compacted"), "session_compact").otherwise("custom")
    )


def promotion_threshold(mode: str, critical: Column) -> Column:
    """The least confidence to keep a fact; null: none is kept."""
    if mode == "off":
        return F.lit(None).cast("double")
    base = {"aggressive": max(0.5, 0.65 - 0.15), "balanced": max(0.55, 0.65 - 0.10)}.get(mode, 0.65)
    return F.when(critical, max(0.5, base - 0.10)).otherwise(base)


def entry_point(path: Column, type_: Column, incoming: Column, outgoing: Column) -> dict[str, Column]:
    """``kind`` and ``score`` of a symbol as an entry point (null: none); the counts leave out DEFINES edges."""
    index = path.rlike(r"(^|/)index\.[^.]+$")
    package = path.startswith("packages/")
    kind = (
        F.when(path.startswith("bin/"), "cli").when(path.rlike(r"(^|/)(cli)\.[^.]+$"), "cli").when(path.rlike(r"(^|/)(main|server)\.[^.]+$"), "main")
        .when(F.contains(path, F.lit("/runtime/")) & path.rlike(r"(^|/)(bootstrap|index)\.[^.]+$"), "runtime").when(index & (package | (incoming == 0) | (outgoing > 0)), "package")
    )
    base = F.when(path.startswith("bin/"), 100).when(path.rlike(r"(^|/)(cli|main|server)\.[^.]+$"), 90).when(kind == "runtime", 75).when(package, 70).otherwise(55)
    score = F.when(type_ == "route", 100).when(kind.isNotNull(), base + F.when(incoming == 0, 10).otherwise(0))
    return {"kind": F.when(type_ == "route", "route").otherwise(kind), "score": score}


def skill_score(title: Column, task: Column, rest: Column, files: Column, query: str, terms: list[str], names: list[Column] | None = None) -> Column:
    """A name of the skill itself (identifier, fingerprint) 1000; whole query in the task 40, in the title 30; each term anywhere 5, in the task 4, in a file's name 3."""
    q = query.lower().strip()
    exact = F.lit(False)
    for name in names or []:
        exact = exact | (F.lower(name) == q)
    low_task, low_title, low_files = F.lower(task), F.lower(title), F.lower(F.array_join(files, "\n"))
    everything = F.concat_ws("\n", low_title, low_task, F.lower(rest), low_files)
    hit = lambda c, t, w: F.when(F.contains(c, F.lit(t)), w).otherwise(0)
    out = F.when(exact, 1000).otherwise(0) + hit(low_task, q, 40) + hit(low_title, q, 30)
    for t in terms:
        out = out + hit(everything, t, 5) + hit(low_task, t, 4) + hit(low_files, t, 3)
    return out
