"""Rewriting marked spots of a text with Catalyst expressions.

A pass first marks the spots it wants to replace with one ``regexp_replace``:

    gap OPEN payload CLOSE gap OPEN payload CLOSE gap ...

Most texts have one or two spots to a pass. Those are named and put together again
by plain string functions, which Spark compiles. Only where a pass finds more, or a
name is taken, higher-order functions, which Spark interprets, work on arrays of all
payloads and gaps; both ways give the same text.

Expressions are written as Spark SQL text: one parsed string per column is far
cheaper to build from Python than thousands of ``Column`` calls. Every step is its
own projection under new column names, so the optimiser never has to repeat a
sub-expression and the plan grows linearly with the passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .text import CLOSE, OPEN, SEP, SPACE, sql_text

_ONE_MARK = sql_text(f"{OPEN}([^{CLOSE}]*){CLOSE}")
_ENTRY = sql_text(f"{OPEN}([^{SEP}]*){SEP}([^{SEP}]*){SEP}([^{SEP}]*){SEP}([^{OPEN}]*)")
MANY = 3  # what ``fast`` columns say of a text that needs the way for any number of spots


def let(value: str, var: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``var`` in ``body``.

    A fold over nothing hands its start value to its finish function, and unlike
    ``transform`` it does not copy the result.
    """
    return f"aggregate(array(), {value}, (a0, e0) -> a0, {var} -> {body})"


def placeholder(name: str) -> str:
    return f"concat('{{{{.', {name}, '}}}}')"


def sealed(df: DataFrame, *columns: str) -> DataFrame:
    """Keep later filters on computed columns from being pushed below their computation.

    Catalyst moves a filter through a projection by putting the column's expression
    in its place. Through a chain of projections that would repeat the whole
    stage over and over. An ``inline`` of one struct is where it stops; filters on
    the other columns still go through.
    """
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    fields = ", ".join(f"'{c}', `{c}`" for c in columns)
    return df.selectExpr(*kept, f"inline(array(named_struct({fields})))")


class Rewriter:
    """A DataFrame in the middle of the template stage.

    The state is two text columns: the ``text`` so far and the ``log`` of its parameters, an
    entry ``OPEN name SEP kind SEP description SEP example`` for each. A pass leaves them alone
    where its guard (a cheap substring test on the upper-cased statement) or its mark finds nothing.
    """

    def __init__(self, df: DataFrame, sql: str, text: str) -> None:
        self.df = df
        self.kept = df.columns
        self._n = 0
        self.text, self.log, self.upper = self.add(text, "''", f"upper({sql})")

    def add(self, *expressions: str) -> list[str]:
        """One projection with the expressions as new columns; their names."""
        names = [f"__t{self._n + i}" for i in range(1, len(expressions) + 1)]
        self._n += len(names)
        self.df = self.df.selectExpr("*", *[f"{e} AS {n}" for e, n in zip(expressions, names, strict=True)])
        return names

    def mentions(self, *words: str) -> str:
        """Guard: the original statement has one of the upper-case words."""
        return "(" + " OR ".join(f"contains({self.upper}, '{w}')" for w in words) + ")"

    def marked(self, rx: str, mark: str, *empty: tuple[str, str]) -> str:
        """Mark all matches; then put ``empty`` marks, of matches that stay, right again."""
        out = f"regexp_replace({self.text}, {sql_text(rx)}, {sql_text(mark)})"
        for text, instead in empty:
            out = f"replace({out}, '{text}', '{instead}')"
        return f"replace({out}, '{SPACE}', ' ')" if SPACE in mark else out

    def used(self, name: str) -> str:
        """Test: a parameter has the name already."""
        return f"contains({self.log}, concat('{OPEN}', {name}, '{SEP}'))"

    def spots(self, guard: str, marked: str) -> tuple[str, str]:
        """The marked text, and its bits: what stands before the first mark, then a payload with the gap behind it for each."""
        (m,) = self.add(f"if({guard}, {marked}, NULL)")
        (bits,) = self.add(f"if(contains({m}, '{OPEN}'), split({m}, '{OPEN}'), NULL)")
        return m, bits

    def put(self, fast: str, text: str, log: str, m: str, many: Callable[[], str]) -> None:
        """New state: ``text`` and ``log``, or where ``fast`` is MANY the struct that ``many`` makes of the marked text ``m``."""
        self.text, self.log, m = self.add(text, log, f"if({fast} = {MANY}, {m}, NULL)")
        (state,) = self.add(f"if({m} IS NOT NULL, {let(m, 'm', let(f'regexp_extract_all({self.log}, {_ENTRY}, 1)', 'used', many()))}, NULL)")
        self.text, self.log = self.add(f"coalesce({state}.text, {self.text})", f"coalesce({state}.log, {self.log})")

    def replace(self, guard: str, marked: str, about: Callable[[str], str], base: str = "", bases: Callable | None = None) -> None:
        """Turn all marks into named placeholders; what ``about`` says of a payload goes into the log.

        All spots share the name ``base``, or ``bases`` takes payloads and gives columns with a base for each.
        """
        m, bits = self.spots(guard, marked)
        x = self.add(payload(bits, 1), payload(bits, 2))
        if bases:
            first, second = bases(self.add, x)
            n = [first, *self.add(f"if({second} = {first}, concat({second}, '_1'), {second})")]
        else:
            n = [f"'{base}'", f"'{base}_1'"]
        (fast,) = self.add(
            f"CASE WHEN {bits} IS NULL THEN 0 WHEN size({bits}) > 3 OR {self.used(n[0])} THEN {MANY} WHEN size({bits}) = 2 THEN 1 "
            f"WHEN {self.used(n[1])} THEN {MANY} ELSE 2 END"
        )
        text, log = f"get({bits}, 0)", self.log
        texts, logs = [], []
        for i in (1, 2):
            text, log = f"{text}, {placeholder(n[i - 1])}, {gap(bits, i)}", f"{log}, {entry(n[i - 1], about(x[i - 1]), x[i - 1])}"
            texts.append(f"WHEN {i} THEN concat({text})")
            logs.append(f"WHEN {i} THEN concat({log})")
        cases = [f"CASE {fast} {' '.join(whens)} ELSE {old} END" for whens, old in ((texts, self.text), (logs, self.log))]
        names = self._names(f"transform(x, v -> {bases(None, ['v'])[0]})") if bases else self._numbered(base)
        self.put(fast, *cases, m, lambda: self.named("m", about, names))

    def named(self, marked: str, about: Callable[[str], str], names: str, example: Callable[[str], str] = lambda v: v) -> str:
        """Text and log with any number of marks turned into placeholders of the ``names``; ``x`` is the array of payloads."""
        gaps = f"split(regexp_replace({marked}, {_ONE_MARK}, '{OPEN}'), '{OPEN}')"
        text = f"array_join(zip_with({gaps}, k, (g, n) -> concat(g, coalesce({placeholder('n')}, ''))), '')"
        entries = f"transform(k, (n, i) -> {let('get(x, i)', 'v', entry('n', about('v'), example('v')))})"
        state = f"named_struct('text', {text}, 'log', concat({self.log}, array_join({entries}, '')))"
        return let(f"regexp_extract_all({marked}, {_ONE_MARK}, 1)", "x", let(names, "k", state))

    def _one_by_one(self, bases: str) -> str:
        first_free = (
            "get(array_except(transform("
            "sequence(1, size(filter(got, u -> startswith(u, concat(b, '_')))) + 1), "
            "i -> concat(b, '_', i)), got), 0)"
        )
        fold = (
            f"aggregate({bases}, used, (got, b) -> array_append(got, "
            f"if(array_contains(got, b), {first_free}, b)))"
        )
        return f"slice({fold}, size(used) + 1, size({bases}) + 1)"

    def _numbered(self, base: str) -> str:
        """Names for spots of one base: ``base``, ``base_1``, ``base_2`` ... leaving out used ones."""
        wishes = f"transform(x, (e, i) -> if(i = 0, '{base}', concat('{base}_', i)))"
        all_wishes = (
            f"transform(sequence(0, size(x) + size(used)), i -> if(i = 0, '{base}', concat('{base}_', i)))"
        )
        others = f"slice(array_except({all_wishes}, used), 1, size(x))"
        return let(wishes, "w", f"if(arrays_overlap(w, used), {others}, w)")

    def _names(self, bases: str) -> str:
        """One unused name per spot, in text order.

        The n-th use of a base wishes for ``base``, ``base_1``, ``base_2`` ... If all
        wishes differ and none is in use already, they are the answer. Only
        otherwise (a literal happens to look like another one's numbered name)
        the names are given one by one.
        """
        earlier = "i - size(array_remove(slice(a, 1, i), b))"
        wishes = f"transform(a, (b, i) -> {let(earlier, 'n', "if(n = 0, b, concat(b, '_', n))")})"
        clash = "arrays_overlap(w, used) OR size(array_distinct(w)) < size(w)"
        given = f"if({clash}, {self._one_by_one('a')}, w)"
        single = "size(a) = 1 AND NOT array_contains(used, get(a, 0))"
        wished = f"if(size(array_distinct(a)) = size(a), a, {wishes})"
        return let(bases, "a", f"if({single}, a, {let(wished, 'w', given)})")

    def with_new(self, text: str, regs: str) -> str:
        """Text, and the log with those of ``regs`` (name, about, example) added whose name is not in use."""
        fresh = "filter(g, (r, i) -> NOT array_contains(used, r.name) AND array_position(g.name, r.name) = i + 1)"
        entries = f"transform({fresh}, r -> {entry('r.name', 'r.about', 'r.example')})"
        return let(regs, "g", f"named_struct('text', {text}, 'log', concat({self.log}, array_join({entries}, '')))")

    def params(self) -> str:
        """The log as an array of parameters."""
        name, kind, description, example = self.add(*[f"regexp_extract_all({self.log}, {_ENTRY}, {i})" for i in (1, 2, 3, 4)])
        fields = f"{name}, array_repeat('string', size({name})), {description}, {kind}, {example}"
        return f"CAST(arrays_zip({fields}) AS array<struct<name: string, type: string, description: string, kind: string, example: string>>)"

    def done(self, **columns: str) -> DataFrame:
        """The input columns and the given results, sealed."""
        return sealed(self.df.selectExpr(*[f"`{c}`" for c in self.kept], *[f"{e} AS {n}" for n, e in columns.items()]), *columns)


def entry(name: str, about: str, example: str) -> str:
    """A parameter in the log; ``about`` is ``SEP kind SEP`` and the start of the description."""
    return f"concat('{OPEN}', {name}, {about}, {example}, '){SEP}', {example})"


def payload(bits: str, i: int) -> str:
    return f"substring_index(get({bits}, {i}), '{CLOSE}', 1)"


def gap(bits: str, i: int) -> str:
    return f"substring_index(get({bits}, {i}), '{CLOSE}', -1)"


def reg(name: str, about: str, example: str) -> str:
    return f"named_struct('name', '{name}', 'about', {about}, 'example', {example})"


def field(bit: str, i: int) -> str:
    return f"get({bit}.f, {i})"


def cut(marked: str, make: Callable[[str], str]) -> str:
    """Marked text as its ``head`` and one ``items`` entry per mark.

    ``make`` builds an entry from a bit: payload fields ``f`` and the ``gap`` behind it.
    """
    bits = (
        f"transform(slice(p, 2, size(p)), s -> named_struct("
        f"'f', split(substring_index(s, '{CLOSE}', 1), '{SEP}'), "
        f"'gap', substring_index(s, '{CLOSE}', -1)))"
    )
    parts = f"named_struct('head', get(p, 0), 'items', transform({bits}, b -> {make('b')}))"
    return let(f"split({marked}, '{OPEN}')", "p", parts)
