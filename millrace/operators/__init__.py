"""Pattern, memory, metric, action and schedule operators over event tables."""
