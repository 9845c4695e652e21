"""Sources and sinks: layers from tables, multilayer edge lists, synthetic networks."""
