"""Linkage analytics on Spark: what an upgrade of JVM libraries newly breaks, as DataFrame joins over parsed class files."""
