"""Two synthetic copies of a small chain, as FIXTURES.md describes them."""

from __future__ import annotations

import hashlib
from datetime import datetime
from decimal import Decimal

from evenkeel.sources.snapshot import Snapshot

SCHEMAS = {
    "block": "id long, hash binary, block_no int, epoch_no int, slot_no long",
    "tx": "id long, hash binary, block_id long",
    "tx_out": "id long, tx_id long, index int, value decimal(20,0), address string",
    "multi_asset": "id long, policy binary, name binary, fingerprint string",
    "ma_tx_out": "id long, ident long, quantity decimal(20,0), tx_out_id long",
    "stake_address": "id long, hash_raw binary, view string",
    "pool_hash": "id long, hash_raw binary, view string",
    "pool_update": "id long, hash_id long, registered_tx_id long, cert_index int",
    "pool_relay": "id long, update_id long, ipv4 string, port int",
    "epoch_stake": "id long, addr_id long, pool_id long, amount decimal(20,0), epoch_no int",
    "epoch_finalized": "id long, out_sum decimal(38,0), fees decimal(20,0), tx_count int, blk_count int, no int, start_time timestamp, end_time timestamp",
    "epoch_sync_enabled": "singleton boolean, enabled boolean",
    "gov_action_proposal": "id long, tx_id long, index int",
    "meta": "id long, version string",
}


def digest(text: str) -> bytes:
    return hashlib.md5(text.encode()).digest()


def rows(off: int, tip: int) -> dict[str, list[tuple]]:
    d = Decimal
    return {
        "block": [(n + 1 + off, digest(f"block-{n}"), n, 0, n) for n in range(tip)],
        "tx": [(t + off, digest(f"tx-{t}"), t + 1 + off) for t in range(1, tip)],
        "tx_out": [((t - 1) * 2 + o + 1 + off, t + off, o, d(1000 * t + o), f"addr{(t + o) % 3}") for t in range(1, tip) for o in (0, 1)],
        "multi_asset": [(k + off, digest(f"pol-{k}"), digest(f"name-{k}"), f"asset{k}") for k in (1, 2)],
        "ma_tx_out": [(t + off, (t % 2) + 1 + off, d(5 * t), (t - 1) * 2 + 1 + off) for t in range(1, 6)],
        "stake_address": [(1 + off, digest("stake-1"), "stake1xyz")],
        "pool_hash": [(1 + off, digest("pool-1"), "pool1xyz")],
        "pool_update": [(1 + off, 1 + off, 2 + off, 0)],
        "pool_relay": [(1 + off, 1 + off, "1.2.3.4", 52636)],
        "epoch_stake": [(1 + off, 1 + off, 1 + off, d(999), 0)],
        "epoch_finalized": [(1 + off, d(12345), d(678), 5, 6, 0, datetime(2020, 1, 1), datetime(2020, 1, 5))],
        "epoch_sync_enabled": [(True, True)],
        "gov_action_proposal": [],
        "meta": [(1 + off, "v1" if off == 0 else "v2")],
    }


def with_addresses(tables: dict[str, list[tuple]], off: int) -> dict[str, list[tuple]]:
    """The variant whose outputs point at an address table."""
    outs = [(i, t, o, v, (t - off + o) % 3 + 1 + off) for i, t, o, v, _ in tables["tx_out"]]
    addresses = [(k + 1 + off, f"addr{k}", digest(f"addr{k}"), False, None, 1 + off if k == 0 else None) for k in range(3)]
    return tables | {"tx_out": outs, "address": addresses}


ADDRESS_SCHEMAS = SCHEMAS | {
    "tx_out": "id long, tx_id long, index int, value decimal(20,0), address_id long",
    "address": "id long, address string, raw binary, has_script boolean, payment_cred binary, stake_address_id long",
}


def snapshot(spark, label: str, tables: dict[str, list[tuple]], schemas: dict[str, str] = SCHEMAS) -> Snapshot:
    return Snapshot.from_frames(label, {n: spark.createDataFrame(r, schemas[n]) for n, r in tables.items()})
