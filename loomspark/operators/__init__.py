"""DataFrame-in / DataFrame-out jobs. No operator collects data to the driver."""
