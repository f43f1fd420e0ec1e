"""Rules as text, compiled to joins and aggregations.

A program is a list of clauses: rules (`head :- goal, goal`), facts, facts with a probability (`0.1 :: noisy`), sets of
alternatives (`0.5 :: coin(0); 0.5 :: coin(1)`), and network predicates (`nn(net, [X], Y, [0, 1]) :: digit(X, Y)`).
Relations are DataFrames of tuples with probabilities.

Resolution happens while the plan is made, not while it runs: a query is unfolded through the rules, recursion over
lists too, until only relations, facts and arithmetic are left. Each way of unfolding is a branch, a conjunction of
relations that becomes equi-joins with expressions between them; how the branches' proofs add up is settled from what
they share (see Program.query). So Catalyst sees one declarative plan and no rule is interpreted row by row.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.provenance import ExclusiveSum, MaxProd, NoisyOr, Provenance, TopK, geometric_mean

#: Random variables that branches which neither exclude each other nor are independent may have together.
MOST_VARIABLES = 6
#: Steps of resolution before a program counts as endless.
MOST_STEPS = 20_000

_TOKEN = re.compile(r"\s*(?:%[^\n]*\s*)*(::|:-|\\\+|=:=|=\\=|==|!=|=<|<=|>=|//|[-+*/<>=~|,;.()\[\]]|\d+\.\d+|\d+|[A-Za-z_]\w*|\"[^\"]*\")")
_COMPARE = {"=:=": "=", "==": "=", "=": "=", "=\\=": "<>", "!=": "<>", "=<": "<=", "<=": "<=", ">=": ">=", "<": "<", ">": ">"}


@dataclass(frozen=True)
class Var:
    name: str
    copy: int = 0


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Ref:
    """A column of the table of bindings: one known value a row."""

    column: str


@dataclass(frozen=True)
class Node:
    """A functor with arguments; lists are `.`(head, rest) down to `[]`."""

    name: str
    args: tuple = ()


Term = Var | Const | Ref | Node
EMPTY = Node("[]")


def listed(terms: list[Term], rest: Term = EMPTY) -> Term:
    return reduce(lambda tail, head: Node(".", (head, tail)), reversed(terms), rest)


@dataclass(frozen=True)
class Clause:
    head: Node
    body: tuple[Node, ...] = ()


class Parser:
    """Clauses of a text. In `prolog` variables are capitals; in `datalog` all names in arguments are variables."""

    def __init__(self, text: str, style: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            if re.fullmatch(r"\s*(%[^\n]*\s*)*", text[at:]):
                break
            if not (m := _TOKEN.match(text, at)):
                raise ValueError(f"can't read {text[at : at + 30]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at, self.style, self.fresh = 0, style, itertools.count()

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or (want and got != want):
            raise ValueError(f"{want or 'more'} expected before {' '.join(self.tokens[self.at : self.at + 8])!r}")
        self.at += 1
        return got

    def expression(self, level: int = 0) -> Term:
        if level == 2:
            return self.primary()
        ops = (("+", "-"), ("*", "/", "//", "mod"))[level]
        left = self.expression(level + 1)
        while self.peek() in ops:
            op = self.take()
            left = Node(op, (left, self.expression(level + 1)))
        return left

    def primary(self) -> Term:
        got = self.take()
        if got == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if got == "[":
            items, rest = [], EMPTY
            while self.peek() != "]":
                items.append(self.expression())
                if self.peek() == "|":
                    self.take()
                    rest = self.expression()
                elif self.peek() == ",":
                    self.take()
            self.take("]")
            return listed(items, rest)
        if got == "-":
            return Node("-", (Const(0), self.primary()))
        if got[0].isdigit():
            return Const(float(got) if "." in got else int(got))
        if got[0] == '"':
            return Const(got[1:-1])
        if not re.match(r"[A-Za-z_]", got):
            raise ValueError(f"a term expected, not {got!r}")
        if self.peek() == "(":
            return Node(got, self.arguments())
        if got == "_":
            return Var(f"_{next(self.fresh)}")
        return Var(got) if self.style == "datalog" or got[0].isupper() or got[0] == "_" else Node(got)

    def arguments(self) -> tuple[Term, ...]:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.expression())
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        return tuple(out)

    def atom(self) -> Node:
        name = self.take()
        if not re.match(r"[A-Za-z]", name):
            raise ValueError(f"a predicate expected, not {name!r}")
        return Node(name, self.arguments() if self.peek() == "(" else ())

    def goal(self) -> Node:
        if self.peek() in ("\\+", "~", "not"):
            self.take()
            return Node("\\+", (self.atom(),))
        start = self.at
        if re.match(r"[a-z]", self.peek()) and self.peek(1) in ("(", ",", ".", ""):
            got = self.atom()
            if self.peek() in (",", ".", ""):
                return got
            self.at = start
        left = self.expression()
        op = self.take()
        if op != "is" and op not in _COMPARE:
            raise ValueError(f"a comparison expected, not {op!r}")
        return Node(op, (left, self.expression()))

    def goals(self) -> tuple[Node, ...]:
        out = [self.goal()]
        while self.peek() == ",":
            self.take()
            out.append(self.goal())
        return tuple(out)

    def clauses(self) -> Iterator[tuple[list[tuple[Term | None, Node]], tuple[Node, ...]]]:
        """Alternatives (probability or network, head) and the body."""
        while self.peek():
            heads = []
            while True:
                # what stands before :: is a number, a fraction, t(number) or nn(...)
                ahead, depth = self.at, 0
                while ahead < len(self.tokens) and (depth or self.tokens[ahead] not in ("::", ":-", ".", ";")):
                    depth += (self.tokens[ahead] in "([") - (self.tokens[ahead] in ")]")
                    ahead += 1
                weight = None
                if ahead < len(self.tokens) and self.tokens[ahead] == "::":
                    style, self.style = self.style, "prolog"
                    weight = self.expression()
                    self.style = style
                    self.take("::")
                heads.append((weight, self.atom()))
                if self.peek() != ";":
                    break
                self.take()
            body: tuple[Node, ...] = ()
            if self.peek() == ":-":
                self.take()
                body = self.goals()
            if self.peek():
                self.take(".")
            yield heads, body


def _number(t: Term) -> float:
    if isinstance(t, Const):
        return float(t.value)
    if isinstance(t, Node) and t.name == "t":  # a probability that training starts from
        return _number(t.args[0])
    if isinstance(t, Node) and t.name == "/":
        return _number(t.args[0]) / _number(t.args[1])
    raise ValueError(f"no probability: {t}")


@dataclass(frozen=True)
class Relation:
    """Tuples with probabilities: context columns (joined always), argument columns, prob. The arguments before the last
    name a random variable, whose value is the last; variable: a column that names it where it has no arguments."""

    df: DataFrame
    args: tuple[str, ...]
    prob: str | None
    context: tuple[str, ...] = ()
    variable: str | None = None


@dataclass(frozen=True)
class Choice:
    """One alternative of a set of probabilistic facts."""

    group: int
    option: int
    prob: float
    atom: Node


@dataclass
class Branch:
    """A way to prove a query: base goals in order, and what its variables stand for."""

    goals: list[tuple]
    bound: dict[Var, Term]

    def choices(self) -> dict[int, tuple[int, bool]]:
        return {c.group: (c.option, held) for kind, c, held in (g for g in self.goals if g[0] == "choice")}

    def variables(self) -> set:
        out: set = {("choice", g[1].group) for g in self.goals if g[0] == "choice"}
        return out | {("relation", g[1].name, tuple(map(str, walk_all(g[1].args[:-1], self.bound)))) for g in self.goals if g[0] == "relation"}


def walk(t: Term, bound: dict[Var, Term]) -> Term:
    while isinstance(t, Var) and t in bound:
        t = bound[t]
    return t


def walk_all(terms, bound) -> list[Term]:
    return [_deep(t, bound) for t in terms]


def _deep(t: Term, bound: dict[Var, Term]) -> Term:
    t = walk(t, bound)
    return Node(t.name, tuple(_deep(a, bound) for a in t.args)) if isinstance(t, Node) else t


def unify(a: Term, b: Term, bound: dict[Var, Term]) -> tuple[dict[Var, Term], list[tuple]] | None:
    """The bindings that make two terms one, and equalities that only a row can tell; None if they differ."""
    late: list[tuple] = []
    todo = [(a, b)]
    bound = dict(bound)
    while todo:
        x, y = (walk(t, bound) for t in todo.pop())
        if x == y:
            continue
        if isinstance(x, Var):
            bound[x] = y
        elif isinstance(y, Var):
            bound[y] = x
        elif isinstance(x, Ref) or isinstance(y, Ref):
            if isinstance(x, Node) or isinstance(y, Node):
                return None
            late.append(("compare", "=", x, y))
        elif isinstance(x, Node) and isinstance(y, Node) and x.name == y.name and len(x.args) == len(y.args):
            todo += zip(x.args, y.args, strict=True)
        else:
            return None
    return bound, late


@dataclass
class Program:
    """Clauses, relations and networks; query() compiles.

    program = Program('sum_2(a + b) :- digit_1(a), digit_2(b)', style='datalog')
    program.relation('digit_1', first, ['value'], context=['ex'])
    program.relation('digit_2', second, ['value'], context=['ex'])
    program.query('sum_2(s)')
    """

    text: str = ""
    style: str = "prolog"
    rules: dict[tuple[str, int], list[Clause]] = field(default_factory=dict)
    choices: dict[tuple[str, int], list[Choice]] = field(default_factory=dict)
    relations: dict[tuple[str, int], Relation] = field(default_factory=dict)
    neural: dict[tuple[str, int], tuple[str, list]] = field(default_factory=dict)
    networks: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    cached: dict[tuple, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        self._copies, self._groups = itertools.count(1), itertools.count()
        if self.style not in ("prolog", "datalog"):
            raise ValueError(f"no style {self.style!r}; there are prolog, datalog")
        if self.text:
            self.add(self.text)

    def add(self, text: str) -> Program:
        """More clauses."""
        for heads, body in Parser(text, self.style).clauses():
            first = heads[0][0]
            if isinstance(first, Node) and first.name == "nn":
                net, _, _, classes = first.args
                atom = heads[0][1]
                self.neural[atom.name, len(atom.args)] = (net.name, _elements(classes, {}))
            elif first is not None:
                if body:
                    raise ValueError("a rule with a probability: give the probability to a fact that the rule asks for")
                group = next(self._groups)
                if sum(_number(w) for w, _ in heads) > 1 + 1e-9:
                    raise ValueError("alternatives of more than 1 together")
                for option, (weight, atom) in enumerate(heads):
                    self.choices.setdefault((atom.name, len(atom.args)), []).append(Choice(group, option, _number(weight), atom))
            else:
                for _, atom in heads:
                    self.rules.setdefault((atom.name, len(atom.args)), []).append(self._plain(atom, body))
        self.cached.clear()
        return self

    def _plain(self, head: Node, body: tuple[Node, ...]) -> Clause:
        """Expressions in the head become goals of the body."""
        args, more = [], []
        for k, a in enumerate(head.args):
            if isinstance(a, Node) and a.name in ("+", "-", "*", "/", "//", "mod"):
                v = Var(f"_head{k}")
                more.append(Node("is", (v, a)))
                a = v
            args.append(a)
        return Clause(Node(head.name, tuple(args)), (*body, *more))

    def relation(self, name: str, df: DataFrame, args: list[str], prob: str | None = "prob", context: list[str] = (), variable: str | None = None) -> Program:
        """A predicate from a table; without prob all its tuples hold."""
        self.relations[name, len(args)] = Relation(df, tuple(args), prob, tuple(context), variable)
        self.cached.clear()
        return self

    def network(self, name: str, predict: Callable[[], DataFrame], key: str = "vec_id", probs: str = "probs") -> Program:
        """A network under the name that nn(...) clauses use: predict gives a table of an image's key and the array of
        its class probabilities, asked for only when a query needs it."""
        self.networks[name] = lambda: predict().select(F.col(key).alias("key"), F.posexplode(probs).alias("at", "prob"))
        self.cached.clear()
        return self

    def _relation(self, name: str, arity: int) -> Relation | None:
        if (name, arity) in self.relations:
            return self.relations[name, arity]
        if (name, arity) not in self.neural:
            return None
        net, classes = self.neural[name, arity]
        if net not in self.networks:
            raise ValueError(f"no network {net!r}")
        values = F.array(*[F.lit(c.value) for c in classes])
        df = self.networks[net]().select("key", F.get(values, F.col("at")).alias("value"), "prob")
        self.relations[name, arity] = Relation(df, ("key", "value"), "prob")
        return self.relations[name, arity]

    # Resolution

    def branches(self, goals: list[Node], bound: dict[Var, Term] | None = None) -> list[Branch]:
        """All ways to prove the goals."""
        out: list[Branch] = []
        held = [(list(goals), dict(bound or {}), [])]
        for _ in range(MOST_STEPS):
            if not held:
                return out
            todo, bound, base = held.pop()
            if not todo:
                if (b := self._consistent(Branch(base, bound))) is not None:
                    out.append(b)
                continue
            goal, rest = todo[0], todo[1:]
            key = (goal.name, len(goal.args))
            if goal.name in _COMPARE or goal.name == "is":
                held.append((rest, bound, [*base, ("is" if goal.name == "is" else "compare", _COMPARE.get(goal.name, "="), *goal.args)]))
            elif goal.name == "\\+":
                inner = goal.args[0]
                own = self.choices.get((inner.name, len(inner.args)), [])
                if len(own) != 1 or own[0].atom.args:
                    raise ValueError(f"negation of {inner.name}: only of a fact without arguments that has a probability")
                held.append((rest, bound, [*base, ("choice", own[0], False)]))
            elif key == ("member", 2):
                for item in reversed(_elements(goal.args[1], bound)):
                    if (got := unify(goal.args[0], item, bound)) is not None:
                        held.append((rest, got[0], [*base, *got[1]]))
            elif key in self.rules:
                for clause in reversed(self.rules[key]):
                    copy = next(self._copies)
                    new = lambda t, copy=copy: Var(t.name, copy) if isinstance(t, Var) else Node(t.name, tuple(map(new, t.args))) if isinstance(t, Node) else t
                    if (got := unify(goal, new(clause.head), bound)) is not None:
                        held.append(([*map(new, clause.body), *rest], got[0], [*base, *got[1]]))
            elif key in self.choices:
                for choice in reversed(self.choices[key]):
                    copy = next(self._copies)
                    new = lambda t, copy=copy: Var(t.name, copy) if isinstance(t, Var) else Node(t.name, tuple(map(new, t.args))) if isinstance(t, Node) else t
                    if (got := unify(goal, new(choice.atom), bound)) is not None:
                        held.append((rest, got[0], [*base, *got[1], ("choice", choice, True)]))
            elif self._relation(*key) is not None:
                held.append((rest, bound, [*base, ("relation", goal)]))
            else:
                raise ValueError(f"no predicate {goal.name}/{len(goal.args)}")
        raise ValueError("the program doesn't end: recursion has to follow a list of the query")

    @staticmethod
    def _consistent(branch: Branch) -> Branch | None:
        """A branch with each choice once; None if it needs two alternatives of one set."""
        seen: dict[int, tuple] = {}
        goals = []
        for g in branch.goals:
            if g[0] == "choice":
                _, c, held = g
                if c.group in seen:
                    other, before = seen[c.group]
                    if (held and before and other.option != c.option) or (held != before and other.option == c.option):
                        return None
                    if held == before:
                        continue
                seen[c.group] = (c, held)
            goals.append(g)
        return Branch(goals, branch.bound)

    # Compilation

    def query(self, text: str, bindings: DataFrame | None = None, keys: list[str] = (), provenance: Provenance | None = None, output_mapping: list | None = None, engine: str = "exact", k: int = 1, cache: bool = False) -> DataFrame:
        """A query's answers: keys, its free variables (in lower case), prob.

        bindings: a table whose columns stand for the query's names that are equal to them (in any case); keys: the
        columns of it, or of the relations' context, that name a row. Without a provenance, proofs are combined exactly:
        summed where all branches exclude each other, as independent where they share no random variable, else over
        the joint values of what they share, refused beyond MOST_VARIABLES variables. engine `approximate` keeps the
        k best proofs of an answer. output_mapping: one array of the probabilities of these values of the only free
        variable instead of rows, 0 where there is no proof. cache: the answer is kept in memory, and given again
        for the same query on the same bindings, until the program changes.
        """
        if engine not in ("exact", "approximate"):
            raise ValueError(f"no engine {engine!r}; there are exact, approximate")
        name = (text, bindings.semanticHash() if bindings is not None else None, tuple(keys), repr(provenance), tuple(output_mapping or ()), engine, k)
        if cache and name in self.cached:
            return self.cached[name]
        atom = Parser(text, self.style).goal()
        columns = {c.lower(): c for c in bindings.columns} if bindings is not None else {}
        free: list[Var] = []

        def known(t: Term) -> Term:
            if isinstance(t, Var):
                if t.name.lower() in columns:
                    return Ref(columns[t.name.lower()])
                if t not in free and not t.name.startswith("_"):
                    free.append(t)
            return Node(t.name, tuple(map(known, t.args))) if isinstance(t, Node) else t

        branches = self.branches([known(atom)])
        if not branches:
            raise ValueError(f"{text!r} has no proof, whatever the data")
        answer = [*keys, *(v.name.lower() for v in free)]
        if engine == "approximate" and provenance is None:
            provenance = TopK(k, ExclusiveSum(), (), geometric_mean(F.col("prob"), 2))
        if provenance is not None:
            out = provenance.combine(self._proofs(branches, bindings, keys, free), answer)
        elif all(_exclude(a, b) for a, b in itertools.combinations(branches, 2)):
            out = ExclusiveSum().combine(self._proofs(branches, bindings, keys, free), answer)
        elif all(not (a.variables() & b.variables()) for a, b in itertools.combinations(branches, 2)):
            each = [ExclusiveSum().combine(self._proofs([b], bindings, keys, free), answer) for b in branches]
            out = NoisyOr().combine(reduce(DataFrame.unionByName, each), answer)
        else:
            out = self._joint(branches, bindings, keys, free, answer)
        if output_mapping is not None:
            (value,) = [v.name.lower() for v in free]
            slots = F.array(*[F.coalesce(F.max(F.when(F.col(value) == v, F.col("prob"))), F.lit(0.0)) for v in output_mapping])
            out = out.groupBy(*keys).agg(slots.alias("probs"))
        if cache:
            out = self.cached[name] = out.persist()
        return out

    def forward(self, text: str, output_mapping: list, **options) -> Callable[..., DataFrame]:
        """A query as a function of a table: the reasoning layer behind classifiers."""
        return lambda bindings=None: self.query(text, bindings, output_mapping=output_mapping, **options)

    def _proofs(self, branches: list[Branch], bindings: DataFrame | None, keys: list[str], free: list[Var]) -> DataFrame:
        rows = []
        for b in branches:
            df, env = self._join(b.goals, b.bound, bindings, keys)
            columns = [self._column(v, b.bound, env).alias(v.name.lower()) for v in free]
            rows.append(df.select(*keys, *columns, F.col("__prob").alias("prob")))
        return reduce(DataFrame.unionByName, rows)

    def _joint(self, branches, bindings, keys, free, answer) -> DataFrame:
        """Branches that share random variables: all joint values of them, and in each the answers of any branch once."""
        shared = set().union(*(b.variables() for b in branches))
        if len(shared) > MOST_VARIABLES:
            raise ValueError(f"exact inference over {len(shared)} shared variables is refused; {MOST_VARIABLES} at most")
        if any(kind == "choice" for kind, *_ in shared):
            raise ValueError("facts with a probability in branches that share variables: name a provenance")
        # one conjunction of all variables; then each branch is an expression over their values
        values: dict[tuple, Var] = {}
        goals = []
        for b in branches:
            for g in b.goals:
                if g[0] == "relation":
                    at = (g[1].name, tuple(map(str, walk_all(g[1].args[:-1], b.bound))))
                    if at not in values:
                        values[at] = Var(f"_value{len(values)}")
                        goals.append(("relation", Node(g[1].name, (*walk_all(g[1].args[:-1], b.bound), values[at]))))
        df, env = self._join(goals, {}, bindings, keys)
        found = []
        for b in branches:
            own, holds = dict(env), F.lit(True)
            for g in b.goals:
                if g[0] == "relation":
                    value = own[values[g[1].name, tuple(map(str, walk_all(g[1].args[:-1], b.bound)))]]
                    target = walk(g[1].args[-1], b.bound)
                    if isinstance(target, Var) and target not in own:
                        own[target] = value
                    else:
                        holds = holds & (self._column(target, b.bound, own) == value)
                else:
                    holds = self._step(g, b.bound, own, holds)
            found.append(F.when(holds, F.struct(*[self._column(v, b.bound, own).alias(v.name.lower()) for v in free], F.lit(True).alias("_"))))
        each = F.explode(F.array_distinct(F.array_compact(F.array(*found))))
        rows = df.select(*keys, "__prob", each.alias("__a")).select(*keys, *[F.col(f"__a.{v.name.lower()}") for v in free], F.col("__prob").alias("prob"))
        return ExclusiveSum().combine(rows, answer)

    def _column(self, t: Term, bound: dict[Var, Term], env: dict[Var, Column]) -> Column:
        t = walk(t, bound)
        if isinstance(t, Ref):
            return F.col(t.column)
        if isinstance(t, Const):
            return F.lit(t.value)
        if isinstance(t, Var):
            if t not in env:
                raise ValueError(f"{t.name} has no value where it is needed")
            return env[t]
        if t.name in ("+", "-", "*", "/", "//", "mod"):
            a, b = (self._column(x, bound, env) for x in t.args)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "//": lambda: F.floor(a / b), "mod": lambda: F.pmod(a, b)}[t.name]()
        if not t.args:
            return F.lit(t.name)
        raise ValueError(f"{t.name}/{len(t.args)} is no value")

    def _step(self, goal: tuple, bound, env: dict[Var, Column], holds: Column) -> Column:
        """Arithmetic: a new variable gets a value, anything else is a condition."""
        kind, op, left, right = goal
        for a, b in ((left, right), (right, left)) if op == "=" else ():
            a = walk(a, bound)
            if isinstance(a, Var) and a not in env and (kind == "is" or op == "="):
                env[a] = self._column(b, bound, env)
                return holds
        a, b = self._column(left, bound, env), self._column(right, bound, env)
        return holds & {"=": a == b, "<>": a != b, "<=": a <= b, ">=": a >= b, "<": a < b, ">": a > b}[op]

    def _join(self, goals, bound, bindings: DataFrame | None, keys) -> tuple[DataFrame, dict[Var, Column]]:
        """The conjunction of base goals: a table with __prob, and the columns of the variables."""
        df, env, prob = bindings, {}, F.lit(1.0)
        drawn: list[tuple[str, Column, Column, Column]] = []
        for n, goal in enumerate(goals):
            if goal[0] == "choice":
                prob = prob * (goal[1].prob if goal[2] else 1 - goal[1].prob)
            elif goal[0] == "relation":
                atom = goal[1]
                own = self._relation(atom.name, len(atom.args))
                names = [f"__{n}_{k}" for k in range(len(own.args))]
                table = own.df.select(*own.context, *[F.col(c).alias(x) for c, x in zip(own.args, names, strict=True)], (F.col(own.prob) if own.prob else F.lit(1.0)).alias(f"__{n}_p"), *([F.col(own.variable).alias(f"__{n}_v")] if own.variable else []))
                on, later = [], []
                for term, x in zip(atom.args, names, strict=True):
                    term = walk(term, bound)
                    if isinstance(term, Var) and term not in env:
                        env[term] = F.col(x)
                    else:
                        (on if df is not None else later).append(self._column(term, bound, env) == F.col(x))
                if df is None:
                    df = table
                elif own.context:
                    df = df.join(table, list(own.context))
                    later = on
                elif on:
                    df = df.join(table, reduce(lambda a, b: a & b, on))
                else:
                    df = df.crossJoin(table)
                for c in later:
                    df = df.filter(c)
                p = F.col(f"__{n}_p")
                which = F.col(f"__{n}_v") if own.variable else F.struct(*[F.col(x) for x in names[:-1]]) if len(names) > 1 else None
                for name, other, value, _ in drawn:
                    # one random variable read twice: it has one value, and its fact counts once
                    if which is not None and name == (own.variable or atom.name):
                        same = other == which
                        df = df.filter(~same | (value == F.col(names[-1])))
                        p = F.when(same, 1.0).otherwise(p)
                if which is not None:
                    drawn.append((own.variable or atom.name, which, F.col(names[-1]), p))
                prob = prob * p
            else:
                holds = self._step(goal, bound, env, F.lit(True))
                df = df.filter(holds) if goal[1] != "=" or str(holds) != str(F.lit(True)) else df
        if df is None:
            raise ValueError("a query without relations needs a table of bindings")
        return df.withColumn("__prob", prob), env


def _elements(t: Term, bound: dict[Var, Term]) -> list[Term]:
    """Items of a list that is known to its end."""
    out = []
    t = walk(t, bound)
    while isinstance(t, Node) and t.name == ".":
        out.append(t.args[0])
        t = walk(t.args[1], bound)
    if t != EMPTY:
        raise ValueError("a list that isn't known when the plan is made")
    return out


def _exclude(a: Branch, b: Branch) -> bool:
    """Whether two branches can't hold in one world: they need different outcomes of one set of alternatives."""
    x, y = a.choices(), b.choices()
    return any((x[g][1] and y[g][1] and x[g][0] != y[g][0]) or (x[g][0] == y[g][0] and x[g][1] != y[g][1]) for g in x.keys() & y.keys())


__all__ = ["MaxProd", "Program"]
