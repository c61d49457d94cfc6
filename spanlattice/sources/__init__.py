"""Reading and writing: block volumes, JSON trackers, labelled image folders, configuration trees."""
