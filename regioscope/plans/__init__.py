"""End-to-end plans bound to the driver's tables, with oracle SQL twins."""
