from siterank.sources.layers import line_segments, point_rows, raster_cells, read_layer, write_sites
from siterank.sources.staging import drop_stage, stage

__all__ = ["drop_stage", "line_segments", "point_rows", "raster_cells", "read_layer", "stage", "write_sites"]
