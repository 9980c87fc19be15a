"""Sources and sinks: file trees, snapshots, versioned tables."""
