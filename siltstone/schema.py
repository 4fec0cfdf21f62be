"""Schemas, sentinels and geometry of the two logs."""

from __future__ import annotations

from dataclasses import dataclass

#: Sentinels and limits of 32-bit addresses, times and sequence numbers.
INVALID32 = 0xFFFFFFFF
TIME_MAX = 0xFFFFFFFE
#: Record states.
WRITING, VALID, DEAD = 0xFF, 0xFE, 0xFC
STATE_NAMES = {WRITING: "WRITING", VALID: "VALID", DEAD: "DEAD"}
#: Magic numbers of sectors and records, header sizes, key and value limits.
KV_SECTOR_MAGIC, TS_SECTOR_MAGIC = 0x4B564442, 0x54534442
KV_RECORD_MAGIC, TS_RECORD_MAGIC = 0xA5, 0xB6
KV_SECTOR_HEADER, TS_SECTOR_HEADER, KV_RECORD_HEADER, TS_RECORD_HEADER = 16, 20, 16, 12
KEY_MAX, VALUE_MAX = 32, 4095

#: Fixed values by name, as the engine's configuration gives them.
CONSTANTS = {
    "MAX_KEY_LEN": KEY_MAX, "MAX_VAL_LEN": VALUE_MAX, "STATE_WRITING": WRITING, "STATE_VALID": VALID, "STATE_DEAD": DEAD, "TIME_INVALID": INVALID32, "TIME_MAX": TIME_MAX, "SEQ_INVALID": INVALID32, "ADDR_INVALID": INVALID32,
    "KV_SECTOR_MAGIC": KV_SECTOR_MAGIC, "KV_RECORD_MAGIC": KV_RECORD_MAGIC, "KV_VERSION": 2, "TS_SECTOR_MAGIC": TS_SECTOR_MAGIC, "TS_RECORD_MAGIC": TS_RECORD_MAGIC, "MIN_SECTOR_SIZE": 4096, "MAX_SECTORS": 255,
    "KV_MIN_SECTORS": 3, "TS_MIN_SECTORS": 2, "WRITE_GRAN_MAX": 3, "GC_GARBAGE_PCT": 20, "GC_WEAR_THRESHOLD": 100, "GC_W_GARBAGE": 7, "GC_W_WEAR": 3, "GC_W_CAPACITY": 1, "STACK_BUF_SIZE": 64,
}

KV_OPS = "series string, seq long, op string, key binary, value binary"
TS_OPS = "series string, arrival long, op string, req_time long, data binary"
KV_LOG = "sector int, offset long, state int, state_name string, key_len int, value_len int, key_hash int, seq long, data_crc int, data_crc_calc int, crc_ok boolean, key binary, value binary, record_size int"
TS_LOG = "series string, epoch int, sector long, offset long, state int, time long, time_base long, time_delta long, data_len int, data_crc int, crc_ok boolean, data binary, record_size int"
SECTORS = "kind string, sector int, status string, erase_cnt long, create_seq long, garbage_bytes long, live_bytes long, write_off long, time_base long, count int, end_off int"
ANOMALIES = "severity string, message string, sector int, offset long"


def align(value: int, unit: int) -> int:
    return -(-value // unit) * unit


@dataclass(frozen=True)
class Geometry:
    """Sizes that follow from a partition's description."""

    sector_size: int = 4096
    write_gran: int = 0
    sectors: int = 16

    @property
    def gran(self) -> int:
        return 1 << self.write_gran

    @property
    def gc_reserve(self) -> int:
        return 2 if self.sectors >= 16 else 1

    @property
    def kv_start(self) -> int:
        return align(KV_SECTOR_HEADER, self.gran)

    @property
    def kv_cap(self) -> int:
        return self.sector_size - self.kv_start

    @property
    def kv_max_live(self) -> int:
        return (self.sectors - self.gc_reserve) * self.kv_cap

    @property
    def ts_start(self) -> int:
        return align(TS_SECTOR_HEADER, self.gran)

    @property
    def ts_cap(self) -> int:
        return self.sector_size - self.ts_start

    @property
    def ts_max_data(self) -> int:
        return (self.ts_cap - TS_RECORD_HEADER) // self.gran * self.gran

    def check_kv(self) -> None:
        if not 3 <= self.sectors <= 255 or self.sector_size < 4096 or self.sector_size & (self.sector_size - 1) or not 0 <= self.write_gran <= 3:
            raise ValueError(f"no key-value partition: {self}")

    def check_ts(self) -> None:
        if not 2 <= self.sectors <= 255 or not 4096 <= self.sector_size <= 65535 or self.sector_size & (self.sector_size - 1) or not 0 <= self.write_gran <= 1:
            raise ValueError(f"no time-series partition: {self}")


G16 = Geometry()
