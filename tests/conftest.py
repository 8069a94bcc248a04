import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from rosterkit.plans import build_session, ensure_checkpoint_dir
    s = build_session(master="local[*]", shuffle_partitions=8, app="rosterkit-tests")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from seed import seed_tables
    return seed_tables(spark)


@pytest.fixture(scope="session")
def loaded(spark, seed):
    """Seed state after rule enforcement and the purge rules, applied once at the end."""
    from rosterkit.operators import quality, remove
    t, _ = quality.enforce_rules(seed, materialize=True)
    t = remove.purge_small_collaborations(t).tables
    t = remove.purge_orphan_songs(t).tables
    return {k: v.cache() for k, v in t.items()}
