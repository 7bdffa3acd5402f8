"""The credit ledger: an ordered command log, folded into result rows; and its audits.

A fold walks commands in order with a state of two balances a user and the holds. Open holds are unique by
(ref_type, ref_id) over all users, so users who share a reference are folded together: they are one component
of the graph of users and references, mostly a single user. Components are dealt to tasks, and a task streams
sorted rows, so what it holds is one component's state, not its log.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.operators.components import connected_components

COMMANDS = "seq long, user_id string, op string, amount long, ref_type string, ref_id string, idem string, ttl_s long, now double"
RESULTS = "seq long, user_id string, op string, status string, kind string, delta long, idem string, available long, uncollected long"


class Refused(Exception):
    """A command that fails and changes nothing."""


@dataclass
class Account:
    unlimited: bool = False
    purchased: int = 0
    subscription: int = 0
    expires: float | None = None
    held: int = 0
    overdraft: int = 100

    def available(self, now: float) -> int:
        return self.purchased + (self.subscription if self.expires is None or self.expires > now else 0) - self.held

    def take(self, amount: int) -> None:
        """Subscription credits go first."""
        part = min(max(self.subscription, 0), max(amount, 0))
        self.subscription -= part
        self.purchased -= max(amount, 0) - part

    def sound(self) -> bool:
        return self.held >= 0 and self.purchased + self.subscription >= -self.overdraft


@dataclass
class Hold:
    user: str
    amount: int
    number: int
    open: bool = True


@dataclass
class Books:
    """What a fold knows of one component: accounts, the latest hold of each reference, and keys that were used."""

    accounts: dict[str, Account] = field(default_factory=dict)
    holds: dict[tuple, Hold] = field(default_factory=dict)
    seen: set[tuple[str, str]] = field(default_factory=set)

    def apply(self, c) -> list[tuple]:
        """(user, status, kind, delta, idempotency key, available, uncollected) of each ledger row that a command gives; kind None: no row."""
        owner = self.holds[ref].user if c.op in ("topup", "settle", "void") and (ref := (c.ref_type, c.ref_id)) in self.holds else c.user_id
        before, hold = self.accounts.get(owner), self.holds.get((c.ref_type, c.ref_id))
        before, hold = before and replace(before), hold and replace(hold)
        rows: list[tuple] = []
        try:
            status = getattr(self, c.op)(c, owner, rows)
            if owner in self.accounts and not self.accounts[owner].sound() or c.op == "topup" and self.holds[ref].amount < 0:
                raise Refused("constraint")
        except Refused as e:
            # nothing of a command that fails stays, an expiry that it saw neither
            status = str(e)
            self.seen.difference_update((owner, r[2]) for r in rows)
            rows.clear()
            for where, key, old in ((self.accounts, owner, before), (self.holds, (c.ref_type, c.ref_id), hold)):
                if old is not None:
                    where[key] = old
                elif where is self.accounts or c.op == "hold":
                    where.pop(key, None)
        left = self.accounts[owner].available(float(c.now)) if owner in self.accounts else None
        return [(owner, "ok", kind, delta, key, left, missing) for kind, delta, key, missing in rows if kind == "expire"] + (
            [(owner, status, kind, delta, key, left, missing) for kind, delta, key, missing in rows if kind != "expire"] or [(owner, status, None, 0, None, left, 0)]
        )

    def _row(self, rows: list[tuple], user: str, kind: str, delta: int, key: str, missing: int = 0) -> None:
        """A ledger row, unless its key was used."""
        if (user, key) not in self.seen:
            self.seen.add((user, key))
            rows.append((kind, delta, key, missing))

    def _known(self, user: str) -> Account:
        if user not in self.accounts:
            raise Refused("no_account")
        return self.accounts[user]

    def _expire(self, user: str, now: float, rows: list[tuple]) -> None:
        a = self.accounts[user]
        if a.expires is not None and a.expires <= now and a.subscription:
            lost, key = a.subscription, f"expire:{user}:{floor(a.expires + 0.5)}"
            a.subscription, a.expires = 0, None
            self._row(rows, user, "expire", -lost, key)

    def ensure(self, c, user: str, rows: list[tuple], unlimited: bool = False) -> str:
        if user not in self.accounts:
            self.accounts[user] = Account(unlimited, int(c.amount or 0))
            if c.amount:
                self._row(rows, user, "grant", int(c.amount), f"seed:{user}")
        return "ok"

    def ensure_unlimited(self, c, user: str, rows: list[tuple]) -> str:
        return self.ensure(c, user, rows, True)

    def grant(self, c, user: str, rows: list[tuple]) -> str:
        a = self.accounts.setdefault(user, Account())
        if (user, c.idem) in self.seen:
            return "replay"
        amount = int(c.amount or 0)
        if c.ttl_s is not None:
            a.subscription += amount
            a.expires = float(c.now) + float(c.ttl_s)
        else:
            a.purchased += amount
        self._row(rows, user, "grant", amount, c.idem)
        return "ok"

    def expire(self, c, user: str, rows: list[tuple]) -> str:
        self._known(user)
        self._expire(user, float(c.now), rows)
        return "ok"

    def spend(self, c, user: str, rows: list[tuple]) -> str:
        amount = int(c.amount or 0)
        if amount < 0:
            raise Refused("invalid_amount")
        a = self._known(user)
        if (user, c.idem) in self.seen:
            return "replay"
        self._expire(user, float(c.now), rows)
        if not a.unlimited and a.available(float(c.now)) < amount:
            raise Refused("insufficient_credits")
        charged = 0 if a.unlimited else amount
        a.take(charged)
        self._row(rows, user, "spend", -charged, c.idem)
        return "ok"

    def hold(self, c, user: str, rows: list[tuple]) -> str:
        amount, ref = int(c.amount or 0), (c.ref_type, c.ref_id)
        if amount < 0:
            raise Refused("invalid_amount")
        a = self._known(user)
        self._expire(user, float(c.now), rows)
        if ref in self.holds and self.holds[ref].open:
            return "replay"
        if not a.unlimited and a.available(float(c.now)) < amount:
            raise Refused("insufficient_credits")
        self.holds[ref] = Hold(user, amount, int(c.seq))
        a.held += amount
        self._row(rows, user, "hold", 0, c.idem or f"hold:{ref[0]}:{ref[1]}:{c.seq}")
        return "ok"

    def _held(self, c) -> Hold:
        if (c.ref_type, c.ref_id) not in self.holds:
            raise Refused("no_hold")
        return self.holds[c.ref_type, c.ref_id]

    def topup(self, c, user: str, rows: list[tuple]) -> str:
        h, extra = self._held(c), int(c.amount or 0)
        if not h.open:
            raise Refused("hold_not_open")
        self._expire(user, float(c.now), rows)
        a = self.accounts[user]
        if not a.unlimited and a.available(float(c.now)) < extra:
            raise Refused("insufficient_credits")
        h.amount += extra
        a.held += extra
        return "ok"

    def _close(self, c, user: str) -> Hold | None:
        """The hold, closed and released; none if it was closed before."""
        h = self._held(c)
        if not h.open:
            return None
        h.open = False
        self.accounts[user].held = max(self.accounts[user].held - h.amount, 0)
        return h

    def settle(self, c, user: str, rows: list[tuple]) -> str:
        a, actual = self.accounts.get(user), int(c.amount or 0)
        if (h := self._close(c, user)) is None:
            return "replay"
        charged = missing = 0
        if not a.unlimited and actual > 0:
            charged = min(actual, max(a.purchased + a.subscription + a.overdraft, 0))
            missing = actual - charged
            a.take(charged)
        self._row(rows, user, "settle", -charged, f"settle:{c.ref_type}:{c.ref_id}:{h.number}", missing)
        return "ok"

    def void(self, c, user: str, rows: list[tuple]) -> str:
        if (h := self._close(c, user)) is None:
            return "replay"
        self._row(rows, user, "void", 0, f"void:{c.ref_type}:{c.ref_id}:{h.number}")
        return "ok"


def components_of(commands: DataFrame) -> DataFrame:
    """user_id and the component of users who share references, for users who share any."""
    uses = commands.filter("ref_id IS NOT NULL").select("user_id", F.struct("ref_type", "ref_id").alias("ref")).distinct()
    edges = uses.join(uses.groupBy("ref").agg(F.min("user_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "ref")
    found = connected_components(edges.filter("user_id <> first").select(F.col("user_id").alias("a"), F.col("first").alias("b")).distinct())
    return found.select(F.col("node").alias("user_id"), F.col("root").alias("component"))


def fold(commands: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Every command's result and ledger rows, in order of seq; op is ensure, ensure_unlimited, grant, hold, topup,
    settle, void, spend or expire.

    A grant creates its account, and with ttl_s it goes to the subscription, whose expiry it replaces. Hold,
    topup and spend fail closed, and what fails changes nothing. Settling never fails: it takes what there is
    and reports the rest as uncollected. Topup, settle and void act on the hold's user. Repeats do nothing.
    shared names the components of users (user_id, component) if they are known; without it they are found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, books = None, Books()
        for b in batches:
            rows = []
            for c in b.astype(object).where(b.notna(), None).itertuples(index=False):
                if c.component != component:
                    component, books = c.component, Books()
                rows += [(c.seq, user, c.op, *rest) for user, *rest in books.apply(c)]
            yield pd.DataFrame(rows, columns=["seq", "user_id", "op", "status", "kind", "delta", "idem", "available", "uncollected"])

    if shared is None:
        shared = components_of(commands)
    keyed = commands.join(shared, "user_id", "left").withColumn("component", F.coalesce("component", "user_id"))
    return keyed.repartition("component").sortWithinPartitions("component", "seq").mapInPandas(run, RESULTS)


def balances(results: DataFrame) -> DataFrame:
    """user_id, balance, credits in, credits out from the ledger rows of a fold."""
    return results.filter("kind IS NOT NULL").groupBy("user_id").agg(F.sum("delta").alias("balance"), F.sum(F.greatest("delta", F.lit(0))).alias("credits_in"), F.sum(F.least("delta", F.lit(0))).alias("credits_out"))


def available(purchased: Column, subscription: Column, expires: Column, held: Column, now: Column) -> Column:
    live = expires.isNull() | (expires > now)
    return F.coalesce(purchased + F.when(live, subscription).otherwise(0) - held, F.lit(0))


def imbalanced(accounts: DataFrame, ledger: DataFrame, key: str, balance: str, delta: str) -> DataFrame:
    """Accounts whose balance isn't the sum of their ledger rows; a sound ledger gives none."""
    total = ledger.groupBy(key).agg(F.sum(delta).alias("ledger_sum"))
    return accounts.join(total, key, "left").select(key, balance, F.coalesce("ledger_sum", F.lit(0)).alias("ledger_sum")).filter(F.col(balance) != F.col("ledger_sum"))


def expired_holds(holds: DataFrame, now: Column, grace_s: int = 0, most: int = 200) -> DataFrame:
    """Open holds past their time and grace, the longest overdue first."""
    return holds.filter((F.col("status") == "open") & (F.col("expires_at") + F.make_dt_interval(secs=F.lit(grace_s)) < now)).orderBy("expires_at", "hold_id").limit(most)


def reaper_actions(holds: DataFrame, jobs: DataFrame) -> DataFrame:
    """Overdue holds with action: skip while the job runs, settle at the estimate if it ended well or isn't known, void if it failed."""
    action = F.when(F.col("job_status").isin("queued", "running"), "skip").when(F.col("job_status").isin("failed", "cancelled"), "void").otherwise("settle")
    return holds.join(jobs, "ref_id", "left").withColumn("action", action)


def priced(usage: DataFrame, prices: DataFrame, on: str, units: str, price: str) -> DataFrame:
    """usage with cost from a price list and basis listed or unlisted."""
    return usage.join(prices, on, "left").withColumn("cost", F.round(F.col(units) * F.col(price), 6)).withColumn("basis", F.when(F.col(price).isNull(), "unlisted").otherwise("listed"))
