"""Schedulers choose which matches of a rule fire now; matches that are held wait in a table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.engine import Engine, Stage
from rulespark.operators.storage import settle
from rulespark.plans.rules import Rule

#: From a rule and all its waiting matches, with their number, to a condition on those that fire (None: all; False: none).
Choice = Callable[[Rule, DataFrame, int], "bool | DataFrame | None"]


class Backoff:
    """A rule with more than limit matches is banned for some iterations; both double each time."""

    def __init__(self, limit: int = 1000, ban: int = 5):
        self.limit, self.ban, self.bans, self.until, self.now = limit, ban, {}, {}, 0

    def __call__(self, rule: Rule, matches: DataFrame, n: int) -> bool | None:
        key = id(rule)
        if self.until.get(key, -1) > self.now:
            return False
        times = self.bans.get(key, 0)
        if n > self.limit << times:
            self.bans[key] = times + 1
            self.until[key] = self.now + (self.ban << times)
            return False
        return None

    def tick(self, fired: bool) -> None:
        """The next iteration; if none of the rules fired, the one in which the next ban ends, as those between do nothing."""
        ends = [t for t in self.until.values() if t > self.now]
        self.now = self.now + 1 if fired or not ends else max(self.now + 1, min(ends))


def first(n: int) -> Choice:
    """Fire n matches of a rule in an iteration, by the order of their hashes."""

    def choose(rule: Rule, matches: DataFrame, m: int) -> DataFrame | None:
        return None if m <= n else matches.orderBy(F.xxhash64(*matches.columns), *matches.columns).limit(n)

    return choose


def run_with(engine: Engine, choose: Choice, iterations: int, ruleset: str = "") -> bool:
    """Run a ruleset with a scheduler; whether the last iteration changed anything or left matches waiting.

    Matches that wait stay with their rule: further calls, or plain runs of the ruleset, go on with them.
    """
    engine.flush()
    active = False
    for _ in range(iterations):
        stage, now, active, fired = Stage(), engine.ts, False, False
        for rule in engine.rules_of(ruleset):
            new = engine.matches(rule)
            rule.last_run = now
            held, rule.waiting = rule.waiting, None
            some = [*new, *([held] if held is not None else [])]
            if not some:
                continue
            every, n = settle(reduce(DataFrame.unionByName, some).distinct())
            if not n:
                continue
            chosen = choose(rule, every, n)
            if chosen is False:
                rule.waiting = every
                active = True
                continue
            fired = True
            if isinstance(chosen, DataFrame):
                chosen, m = settle(chosen)
                if m < n:
                    rule.waiting = settle(every.exceptAll(chosen))[0]
                    active = True
                every = chosen
            engine.act(rule, every, stage)
        active |= engine.apply(stage)
        if hasattr(choose, "tick"):
            choose.tick(fired)
        if not active:
            break
    return active
