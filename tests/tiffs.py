from sparkgrid.sources.tiffwriter import *  # noqa: F403
