"""Settings of a store."""

from __future__ import annotations

from dataclasses import dataclass

from .functions.status import InvalidArgument


@dataclass(frozen=True)
class Options:
    """Defaults are those of the store that this engine stands in for."""

    db_path: str = "./ledgerline_data"
    memtable_size_threshold: int = 4 * 1024 * 1024  # bytes of pending changes that make a run
    sync_wal: bool = True  # the manifest that publishes an append is forced to disk
    block_size: int = 4096  # the least size of a page of a run
    bloom_bits_per_key: int = 10  # the rate of a run's Bloom filter on key follows from it
    block_restart_interval: int = 16  # of the analyses of a store's blocks
    level0_compaction_trigger: int = 4
    level_size_multiplier: int = 10
    level1_max_bytes: int = 10 * 1024 * 1024
    max_levels: int = 7
    binary: bool = False

    def __post_init__(self) -> None:
        for name in ("memtable_size_threshold", "block_size", "bloom_bits_per_key", "block_restart_interval", "level0_compaction_trigger", "level_size_multiplier", "level1_max_bytes"):
            if getattr(self, name) < 1:
                raise InvalidArgument(f"{name} must be positive")
        if self.max_levels < 2:
            raise InvalidArgument("max_levels must be 2 or more")

    def level_limit(self, level: int) -> int:
        """Bytes that a level below 0 may hold."""
        return self.level1_max_bytes * self.level_size_multiplier ** (level - 1)


@dataclass(frozen=True)
class ReadOptions:
    verify_checksums: bool = True  # of the pages of runs


@dataclass(frozen=True)
class WriteOptions:
    sync: bool = False  # force this append to disk also where sync_wal is off
