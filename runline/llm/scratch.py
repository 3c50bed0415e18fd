"""Tables in the folder that the cluster shares."""

from runline.sources.scratch import Scratch, partitions, release, shared_folder

__all__ = ["Scratch", "partitions", "release", "shared_folder"]
