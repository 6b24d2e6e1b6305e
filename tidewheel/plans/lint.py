"""Checks workflow functions for calls that replay differently: wall clocks, random numbers, threads."""

from __future__ import annotations

import ast
import inspect
import textwrap

#: Calls that a workflow must not make, with what to use for them.
BANNED = {
    "time.time": "ctx.clock()", "time.monotonic": "ctx.clock()", "time.sleep": "ctx.sleep()", "datetime.now": "ctx.clock()", "datetime.utcnow": "ctx.clock()",
    "datetime.today": "ctx.clock()", "date.today": "ctx.clock()", "uuid.uuid1": "ctx.new_uuid()", "uuid.uuid4": "ctx.new_uuid()", "os.urandom": "ctx.side_effect()",
    "threading.Thread": "ctx.start()", "asyncio.create_task": "ctx.start()",
}
MODULES = {"random": "ctx.side_effect()", "secrets": "ctx.side_effect()"}


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else ""


def lint(flow) -> list[tuple[int, str]]:
    """(line, message) for each such call in a workflow, a function or its source. Functions that it passes to side_effect are free."""
    source = flow if isinstance(flow, str) else textwrap.dedent(inspect.getsource(flow))
    found: list[tuple[int, str]] = []

    def walk(node: ast.AST) -> None:
        if isinstance(node, ast.Call):
            name = _dotted(node.func)
            if name.endswith(".side_effect"):
                return
            short = ".".join(name.split(".")[-2:])
            instead = BANNED.get(short) or MODULES.get(name.split(".")[0] if "." in name else "")
            if instead:
                found.append((node.lineno, f"{name} replays differently; use {instead}"))
        for child in ast.iter_child_nodes(node):
            walk(child)

    walk(ast.parse(source))
    return found
