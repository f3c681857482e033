from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accounts are copied to every executor only while they stay below this size.
BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024

# A filter of account names is sent to the ledger scan while it stays below this size.
FILTER_LIMIT_BYTES = 256 * 1024 * 1024

# The filter: accounts per 64-bit word, bits that an account sets in its word, and what a
# word costs in the map that executors look it up in.
_ACCOUNTS_PER_WORD, _BITS, _WORD_BYTES = 2, 5, 64

# The part of a hot account that an entry is in, in a ledger stored by account, and the
# column of the chart that it joins.
PART, NAME_PART = "account_part", "name_part"

# What a hashed row costs beside its text: row header, four fixed slots, map entry.
_ROW_OVERHEAD_BYTES = 100


def _row_bytes(accounts: DataFrame) -> Column:
    text = (F.coalesce(F.octet_length(c), F.lit(0)) for c in accounts.columns)
    return sum(text, F.lit(_ROW_OVERHEAD_BYTES)).cast("long")


class DuplicateAccounts(ValueError):
    """An account name occurs twice, so a join would count its entries twice."""


def account_key(ledger: DataFrame) -> list[str]:
    """What joins an entry to its account: the account, and its part where the ledger has one."""
    return [c for c in ("account", PART) if c in ledger.columns]


def _word_of(name: str, words: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(words).cast("long"))


def _bits_of(name: str) -> Column:
    """``_BITS`` bits of a word, from the upper bits of the name's hash, six for each."""
    mask = None
    for i in range(_BITS):
        at = F.shiftrightunsigned(F.xxhash64(name), 58 - 6 * i).cast("int").bitwiseAND(F.lit(63))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


@dataclass(frozen=True)
class Selection:
    """Accounts that a query reads. Equal ``key`` means equal accounts, so a size that was
    measured for one query serves all that select the same."""

    key: tuple
    rows: Column  # condition on the account table
    label: Column  # what each entry of such an account is given

    def of(self, chart: ChartOfAccounts) -> DataFrame:
        return chart.df.filter(self.rows).select("name", self.label)


@dataclass(frozen=True)
class ChartOfAccounts:
    """The account table, known to be unique by name and with a measured size.

    Ledgers are usually huge and their chart of accounts small, but nothing
    guarantees the second. The measured size decides how ``attach`` joins. Of a chart that
    is too large as a whole, each selection is measured once and remembered in ``sizes``, as
    rows and bytes. ``parts`` is the chart as it lies beside a ledger stored by account, one
    row for each part of an account.
    """

    df: DataFrame
    rows: int
    size_bytes: int
    broadcast_limit_bytes: int = BROADCAST_LIMIT_BYTES
    filter_limit_bytes: int = FILTER_LIMIT_BYTES
    parts: DataFrame | None = field(default=None, compare=False, repr=False)
    sizes: dict[tuple, tuple[int, int]] = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def verified(
        cls, df: DataFrame, broadcast_limit_bytes: int = BROADCAST_LIMIT_BYTES
    ) -> ChartOfAccounts:
        """Check uniqueness and measure the size, in one job over the account table."""
        named = df.filter(F.col("name").isNotNull())
        facts = (
            named.groupBy("name")
            .agg(F.count("*").alias("copies"), F.sum(_row_bytes(named)).alias("row_bytes"))
            .agg(
                F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum("row_bytes"), F.lit(0)).alias("size_bytes"),
                F.max(F.when(F.col("copies") > 1, F.col("name"))).alias("duplicate"),
            )
            .first()
        )
        if facts["duplicate"] is not None:
            raise DuplicateAccounts(
                f"account name {facts['duplicate']!r} is not unique; "
                "joined sums would count its entries more than once"
            )
        return cls(named, facts["rows"], facts["size_bytes"], broadcast_limit_bytes)

    def with_broadcast_limit(
        self, limit_bytes: int, filter_limit_bytes: int | None = None
    ) -> ChartOfAccounts:
        """The same chart with another bound for accounts, and for filters if one is given."""
        if filter_limit_bytes is None:
            filter_limit_bytes = self.filter_limit_bytes
        return replace(
            self, broadcast_limit_bytes=limit_bytes, filter_limit_bytes=filter_limit_bytes
        )

    def under(self, parents: Sequence[str]) -> Selection:
        """Accounts directly below one of the given parents (one level, no recursion)."""
        return Selection(
            ("parents", *sorted(set(parents))),
            F.col("parent_account").isin(list(parents)),
            F.col("parent_account"),
        )

    def of_root_types(self, root_types: Sequence[str]) -> Selection:
        return Selection(
            ("roots", *sorted(set(root_types))),
            F.col("root_type").isin(list(root_types)),
            F.col("root_type"),
        )

    def measure(self, *selections: Selection) -> None:
        """Measure all selections that need it and are not yet known, in one job: plain
        sums of rows and bytes for each. A chart that is small as a whole needs no look,
        nor does one that neither accounts nor a filter of may be broadcast."""
        if self.size_bytes <= self.broadcast_limit_bytes:
            return
        if self.broadcast_limit_bytes <= 0 and self.filter_limit_bytes <= 0:
            return
        unknown = {s.key: s for s in selections if s.key not in self.sizes}
        if unknown:
            sums = []
            for s in unknown.values():
                sums.append(F.coalesce(F.count_if(s.rows), F.lit(0)))
                sums.append(F.coalesce(F.sum(F.when(s.rows, _row_bytes(self.df))), F.lit(0)))
            found = self.df.agg(*sums).first()
            self.sizes.update(zip(unknown, zip(found[::2], found[1::2], strict=True), strict=True))

    def fits_broadcast(self, selection: Selection) -> bool:
        """Whether the selected accounts are few and short enough to be copied."""
        if self.size_bytes <= self.broadcast_limit_bytes:
            return True
        if self.broadcast_limit_bytes <= 0:
            return False
        self.measure(selection)
        return self.sizes[selection.key][1] <= self.broadcast_limit_bytes

    def narrowed(self, ledger: DataFrame, selection: Selection) -> DataFrame:
        """Drop ledger rows where they are read whose account is surely not selected.

        The selected names go to the scan as a filter: each sets some bits in one of many
        64-bit words, which is looked up by its number. A name that was not set passes by
        chance in less than one of a thousand cases; none that was set is dropped. A word
        serves two accounts, so this costs some 30 bytes per account however long its name,
        and is sent when the measured number of accounts keeps it within
        ``filter_limit_bytes``. A selection of more than half of the chart would drop too
        little and is not filtered by.
        """
        self.measure(selection)
        rows, _ = self.sizes.get(selection.key, (None, None))
        if rows is None:
            return ledger
        words = max(1, -(-rows // _ACCOUNTS_PER_WORD))
        if 2 * rows > self.rows or words * _WORD_BYTES > self.filter_limit_bytes:
            return ledger
        names = self.df.filter(selection.rows).select(
            _word_of("name", words).alias("filter_word"), _bits_of("name").alias("bits")
        )
        sent = names.groupBy("filter_word").agg(F.bit_or("bits").alias("filter_bits"))
        mask = _bits_of("account")
        may_be = (_word_of("account", words) == F.col("filter_word")) & (
            F.col("filter_bits").bitwiseAND(mask) == mask
        )
        # words are unique, so this inner join repeats no entry
        return ledger.join(F.broadcast(sent), may_be).drop("filter_word", "filter_bits")

    def label(self, ledger: DataFrame, selected: DataFrame) -> DataFrame:
        """Inner join of ledger rows with accounts that fit a broadcast.

        Ledger rows are dropped or labelled where they are read; none is shuffled. The
        lookup goes by a 64-bit hash of the name, since Spark probes a map of longs
        several times faster than one of strings. Names themselves are then compared,
        so that equal hashes cannot mix accounts up. That comparison is spelled as a
        range, because an equality would become part of the lookup key again.
        """
        copies = F.broadcast(selected.withColumn("name_hash", F.xxhash64("name")))
        same_hash = F.xxhash64("account") == F.col("name_hash")
        same_name = F.col("account").between(F.col("name"), F.col("name"))
        return ledger.join(copies, same_hash & same_name).drop("name", "name_hash")

    def attach(self, ledger: DataFrame, selection: Selection, sums: Sequence[str]) -> DataFrame:
        """Inner join of ledger rows with the selected accounts on the account name.

        ``sums`` are the ledger columns that the caller is going to add up. All other
        columns are keys.

        A small selection is broadcast. For a large one the ledger is first filtered where it
        is read (``narrowed``), so that little but entries of selected accounts is shuffled.
        With the account as the only key, it is then summed per account, with partial sums before the shuffle,
        so that an account with a large part of all entries arrives as one row; the join
        reuses that shuffle. With further keys such a sum would hardly shorten the ledger
        and cost it a second shuffle: it is joined as it is, on one shuffle by account,
        whose hot partitions adaptive execution splits, and the caller's sum starts in the
        tasks of the join. The merge hint keeps Spark from broadcasting after all, on the
        word of a file size that compression has made small.

        A ledger stored by account (``write_books_by_account``) lies as that shuffle would
        deal it, and is summed and joined where it is read.
        """
        selected = selection.of(self)
        if self.fits_broadcast(selection):
            return self.label(ledger, selected)
        ledger = self.narrowed(ledger, selection)
        same = F.col("account") == F.col("name")
        if self.parts is None:
            ledger = ledger.drop(PART)
        elif PART in ledger.columns:
            selected = self.parts.filter(selection.rows).select("name", NAME_PART, selection.label)
            same &= F.col(PART) == F.col(NAME_PART)
        keys = account_key(ledger)
        if [c for c in ledger.columns if c not in sums] == keys:
            ledger = ledger.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
        return ledger.join(selected.hint("merge"), same).drop("name", PART, NAME_PART)
