"""Sources and sinks: shard lists, tar archives, image folders, synthetic images, run histories and reports."""
