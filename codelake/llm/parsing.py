"""Table-driven parsers made from the bundled grammars.

A grammar names rules as regular expressions over token classes in which recursion only goes through bracket pairs, so
it describes a visibly pushdown language: an opening bracket pushes, its closing one pops, everything else moves within
a finite table. The tables are the determinised automata of the rules, worked out state by state as texts first need
them and kept for the rest of the task; parsing is one table step per token, with runs between brackets remembered whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache
from importlib import resources

OPEN, CLOSE = "([{\x01", ")]}\x02"  # the last pair is indent and dedent
INDENT, DEDENT = "\x01", "\x02"
PAIR = dict(zip(OPEN, CLOSE, strict=True))
NEWLINE = "\n"
BAD = "\x00"  # a token that no grammar knows
RUNS = re.compile(r"[(\[{\x01)\]}\x02]|[^(\[{\x01)\]}\x02]+")
#: Runs of tokens that are remembered whole: how many a table keeps, and how long one is at most.
MOST_RUNS, LONGEST_RUN = 50_000, 48
_NOTATION = re.compile(r"\s*(?:'((?:[^'\\]|\\.)+)'|([A-Za-z_]\w*)|([()|*+?]))")


@dataclass
class Grammar:
    """Rules and directives of one language, as read from its text."""

    rules: dict[str, str] = field(default_factory=dict)
    directives: dict[str, str] = field(default_factory=dict)


@cache
def read_grammar(name: str) -> Grammar:
    """``name = expression`` with indented continuation lines, ``%directive value``, ``#`` comments; ``%include`` comes first and is overridden."""
    grammar = Grammar()
    text = resources.files("codelake.llm").joinpath(f"grammars/{name}.grammar").read_text("utf-8")
    lines: list[str] = []
    for line in text.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        if line[0].isspace():
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    for line in lines:
        if line.startswith("%"):
            key, _, value = line[1:].partition(" ")
            if key == "include":
                base = read_grammar(value.strip())
                grammar.rules |= base.rules
                grammar.directives |= base.directives
            else:
                grammar.directives[key] = value.strip()
        else:
            key, _, value = line.partition("=")
            grammar.rules[key.strip()] = value.strip()
    return grammar


class Tables:
    """The automata of one grammar. ``terminals`` maps the text of a token, or ``<CLASS>``, to its character."""

    def __init__(self, grammar: Grammar):
        self.rules = grammar.rules
        self.terminals: dict[str, str] = {c: c for c in OPEN + CLOSE} | {"<INDENT>": INDENT, "<DEDENT>": DEDENT, "<NEWLINE>": NEWLINE}
        self.insert = self.terminal(grammar.directives["insert"]) if "insert" in grammar.directives else None
        self.before_brace = self.insert or (self.terminal(grammar.directives["before_brace"]) if "before_brace" in grammar.directives else None)
        self.moves: list[dict[str, list[int]]] = []  # by state of the undetermined automaton
        self.skips: list[list[int]] = []
        self.calls: list[list[tuple[str, int, int]]] = []  # opening bracket, bracket rule, state behind it
        self.later: list[list[tuple[list, int]]] = []  # parts not built yet, with the state behind them
        self.trees: dict[str, list] = {}
        self.begun: dict[tuple[str, int], int] = {}
        self.inner: dict[int, int] = {}
        self.bounds: list[tuple[int, int]] = []  # start and end state by bracket rule
        for name in self.rules:
            self.parse_rule(name)
        top = self.bracket_rule(["rule", "file"])
        self.sets: list[frozenset[int]] = []
        self.after_newline: list[bool] = []
        self.known: dict[tuple[frozenset[int], bool], int] = {}
        self.steps: list[dict[str, int]] = []  # by token; -1 where the table has nothing
        self.runs: dict[tuple[int, str], int] = {}
        self.returns: dict[tuple[int, str, int], int] = {}
        self.first = self.number(self.closure({self.bounds[top][0]}))
        self.last = self.bounds[top][1]

    # reading the notation ------------------------------------------------------------------------------------------

    def terminal(self, text: str) -> str:
        if text not in self.terminals:
            self.terminals[text] = chr(0x100 + len(self.terminals))
        return self.terminals[text]

    def parse_rule(self, name: str) -> list:
        """The rule as nested lists: [kind, *parts]."""
        if name in self.trees:
            return self.trees[name]
        tokens = [m.groups() for m in _NOTATION.finditer(self.rules[name])]
        position = 0

        def alternatives(until: str | None) -> list:
            nonlocal position
            options = [["all"]]
            while position < len(tokens):
                quoted, word, sign = tokens[position]
                if sign == ")" or (quoted is not None and quoted in CLOSE and quoted == until):
                    break
                position += 1
                if sign == "|":
                    options.append(["all"])
                elif sign in ("*", "+", "?") and sign:
                    options[-1].append([sign, options[-1].pop()])
                elif sign == "(":
                    inside = alternatives(None)
                    position += 1
                    options[-1].append(inside)
                elif quoted is not None and quoted in OPEN or word == "INDENT":
                    opening = quoted or INDENT
                    inside = alternatives(PAIR[opening])
                    position += 1
                    options[-1].append(["bracket", opening, inside])
                elif word == "DEDENT":
                    position -= 1
                    break
                elif quoted is not None:
                    options[-1].append(["token", self.terminal(quoted.replace("\\'", "'").replace("\\\\", "\\"))])
                elif word.isupper():
                    options[-1].append(["token", self.terminal(f"<{word}>")])
                else:
                    options[-1].append(["rule", word])
            return ["any", *options] if len(options) > 1 else options[0]

        self.trees[name] = alternatives(None)
        return self.trees[name]

    def bracket_rule(self, tree: list) -> int:
        if id(tree) not in self.inner:
            self.inner[id(tree)] = len(self.bounds)
            start, end = self.state(), self.state()
            self.bounds.append((start, end))
            self.later[start].append((tree, end))
        return self.inner[id(tree)]

    # the undetermined automaton, built as far as texts reach --------------------------------------------------------

    def state(self) -> int:
        self.moves.append({})
        self.skips.append([])
        self.calls.append([])
        self.later.append([])
        return len(self.moves) - 1

    def build(self, tree: list, start: int, end: int) -> None:
        """One level of a part between two states. A rule begun before the same state is the same part, so that right recursion ends."""
        kind = tree[0]
        if kind == "token":
            self.moves[start].setdefault(tree[1], []).append(end)
        elif kind == "bracket":
            self.calls[start].append((tree[1], self.bracket_rule(tree[2]), end))
        elif kind == "rule":
            key = (tree[1], end)
            if key not in self.begun:
                self.begun[key] = self.state()
                self.later[self.begun[key]].append((self.parse_rule(tree[1]), end))
            self.skips[start].append(self.begun[key])
        elif kind == "all":
            for number, part in enumerate(tree[1:], 2):
                after = self.state() if number < len(tree) else end
                self.later[start].append((part, after))
                start = after
            if len(tree) == 1:
                self.skips[start].append(end)
        elif kind == "any":
            for part in tree[1:]:
                self.later[start].append((part, end))
        else:  # * + ?
            again = self.state()
            self.later[again if kind != "?" else start].append((tree[1], again if kind != "?" else end))
            if kind == "?":
                self.skips[start].append(end)
            elif kind == "*":
                self.skips[start].append(again)
                self.skips[again].append(end)
            else:
                self.later[start].append((tree[1], again))
                self.skips[again].append(end)

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            state = todo.pop()
            while self.later[state]:
                part, end = self.later[state].pop()
                self.build(part, state, end)
            for after in self.skips[state]:
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return frozenset(s for s in seen if self.moves[s] or self.calls[s] or not self.skips[s])

    # the tables ----------------------------------------------------------------------------------------------------

    def number(self, states: frozenset[int], newline: bool = False) -> int:
        key = (states, newline)
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(states)
            self.after_newline.append(newline)
            self.steps.append({})
        return self.known[key]

    def step(self, state: int, token: str) -> int:
        """Where a token leads; behind a line's end a missing statement end may be put in before it."""
        known = self.steps[state].get(token)
        if known is None:
            if token == NEWLINE and self.insert:
                known = self.number(self.sets[state], True)
            else:
                reached = {after for s in self.sets[state] for after in self.moves[s].get(token, ())}
                known = self.number(self.closure(reached)) if reached else -1
                if known < 0 and self.after_newline[state] and token != self.insert:
                    ended = self.step(self.number(self.sets[state]), self.insert)
                    known = self.step(ended, token) if ended >= 0 else -1
            self.steps[state][token] = known
        return known

    def enter(self, state: int, opening: str) -> int:
        known = self.steps[state].get(opening)
        if known is None:
            starts = {self.bounds[rule][0] for s in self.sets[state] for bracket, rule, _ in self.calls[s] if bracket == opening}
            known = self.number(self.closure(starts)) if starts else -1
            self.steps[state][opening] = known
        return known

    def leave(self, outer: int, opening: str, inner: int) -> int:
        key = (outer, opening, inner)
        known = self.returns.get(key)
        if known is None:
            ends = self.sets[inner]
            if self.before_brace and opening == "{":  # a last statement needs no end
                ended = self.step(self.number(ends), self.before_brace)
                ends = ends | (self.sets[ended] if ended >= 0 else frozenset())
            reached = {after for s in self.sets[outer] for bracket, rule, after in self.calls[s] if bracket == opening and self.bounds[rule][1] in ends}
            known = self.number(self.closure(reached)) if reached else -1
            self.returns[key] = known
        return known

    def run(self, state: int, tokens: str) -> int:
        for token in tokens:
            state = self.step(state, token)
            if state < 0:
                break
        return state

    def accepts(self, tokens: str) -> int:
        """-1 if the tokens are a whole text of the language, else the position of the first token that cannot stand there."""
        state, at, runs = self.first, 0, self.runs
        stack: list[tuple[int, str]] = []
        for run in RUNS.findall(tokens):
            if run in PAIR:
                inner = self.enter(state, run)
                if inner < 0 and self.after_newline[state]:
                    state = self.step(self.number(self.sets[state]), self.insert)
                    inner = self.enter(state, run) if state >= 0 else -1
                if inner < 0:
                    return at
                stack.append((state, run))
                state = inner
            elif run in CLOSE:
                if not stack or PAIR[stack[-1][1]] != run:
                    return at
                outer, opening = stack.pop()
                state = self.leave(outer, opening, state)
                if state < 0:
                    return at
            else:
                after = runs.get((state, run))
                if after is None:
                    after = self.run(state, run)
                    if len(run) <= LONGEST_RUN:
                        if len(runs) >= MOST_RUNS:
                            runs.clear()
                        runs[state, run] = after
                if after < 0:
                    for offset, token in enumerate(run):
                        state = self.step(state, token)
                        if state < 0:
                            return at + offset
                state = after
            at += len(run)
        if not stack and (self.last in self.sets[state] or (self.insert and (ended := self.step(self.number(self.sets[state]), self.insert)) >= 0 and self.last in self.sets[ended])):
            return -1
        return at
