"""Fixed values of the data model."""

EARTH_RADIUS = 6378137.0
ARENA_METRES = 3000.0
ARENA_HALF = 1500.0
CELL_METRES = 2.0
CELL_AREA = 4
GRID_CELLS = 1500
CHUNK_CELLS = 256
CHUNK_METRES = 512.0
CHUNKS_PER_AXIS = 6
RADIUS_START, RADIUS_CAP, GROWTH = 18.0, 500.0, 0.06
FIT_TOLERANCE, BOUNDARY_EPS, MOTION_EPS = 1.06, 1e-8, 1e-9
EDGE_EPS = 8 * 2.0**-52
NATIVE_ZOOM, TILES_PER_AXIS = 14, 16384
LATITUDE_LIMIT = 84.9
MERCATOR_LIMIT = 85.0511287798066
MILESTONES = (10_000, 50_000, 100_000, 500_000, 1_000_000, 2_500_000, 5_000_000)
GOALS = (100_000, 10_000, 1_000, 100)
SECTOR_METRES = 10_000.0
WATER_HALO = 500.0
