"""Constants of the data model; see ``check`` for the relations between them."""

# Fixed values of the data model.
SKETCH_BITS = 128
SKETCH_BYTES = 16
IDS_PER_CONTAINER = 256
MAX_FEATURES = 200
MAX_BINARY = 100 << 20
MAX_SOURCES = 10000
MAX_HASH = 20000
MIN_SIZE_INDEX = 50
MIN_SIZE_QUERY = 20
GRAPH_DISTANCE = 3
SEARCH_DISTANCE = 4
MIN_ENTROPY = 4.4
LOG_FLOOR = 0.001
LOWE_RATIO = 0.25
RANK_ALPHA = 0.5
RANK_EPSILON = 1e-5
RANK_STEPS = 1000
MAX_DEGREE = 1000
EXPAND_LIMIT = 1000
CHECKSUM_BUCKETS = 1024
RANGE_HITS = 500
SAMPLE_EVERY = 1000
INDEX_OFFSETS = (0, 32, 64, 96)


def check() -> None:
    assert SKETCH_BITS == 8 * SKETCH_BYTES
    assert IDS_PER_CONTAINER == 1 << 8
    assert GRAPH_DISTANCE <= SEARCH_DISTANCE <= len(INDEX_OFFSETS)
    assert MIN_SIZE_QUERY <= MIN_SIZE_INDEX
    assert all(o % 8 == 0 for o in INDEX_OFFSETS)
